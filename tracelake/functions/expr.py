"""Arithmetic expressions in text form as Columns, without Python's eval."""

from __future__ import annotations

import ast
import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_log(x: Column) -> Column:
    """-inf at 0 and NaN below, where SQL gives null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x.isNotNull(), F.lit(float("nan")))


def safe_sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x)).when(x.isNotNull(), F.lit(float("nan")))


_CALLS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": safe_log, "sqrt": safe_sqrt, "abs": F.abs}
_NAMES = {"pi": math.pi, "e": math.e}
_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Pow: F.pow,
}


def compile_expression(text: str, variables: Mapping[str, Column]) -> Column:
    """Column of an expression over + - * / ** (or ^), the functions above, pi, e and ``variables``."""

    def walk(node: ast.AST) -> Column:
        match node:
            case ast.Expression():
                return walk(node.body)
            case ast.Constant(value=int() | float()) if not isinstance(node.value, bool):
                return F.lit(float(node.value))
            case ast.Name(id=name) if name in variables:
                return variables[name]
            case ast.Name(id=name) if name in _NAMES:
                return F.lit(_NAMES[name])
            case ast.UnaryOp(op=ast.USub()):
                return -walk(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return walk(node.operand)
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](walk(node.left), walk(node.right))
            case ast.Call(func=ast.Name(id=name), args=[only], keywords=[]) if name in _CALLS:
                return _CALLS[name](walk(only))
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return walk(ast.parse(text.replace("^", "**"), mode="eval"))
