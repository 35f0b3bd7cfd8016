"""Programs as methods of a dataset, one after the other.

    Chain.read(spark, "file:///in.rsf").bandpass(low=8, high=60).agc(rect=0.2).write("file:///out.rsf")

Methods are the programs of ``commands`` under their own names, with their
parameters as keywords; a method of two datasets takes the other one first.  A
chain is a plan: nothing runs before ``write``, a table of numbers, or ``df``
is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tracelake import commands
from tracelake.cube import Cube
from tracelake.operators import complexes
from tracelake.sources import rsf


def _word(value: object) -> str:
    if isinstance(value, bool):
        return "y" if value else "n"
    if isinstance(value, (list, tuple)):
        return ",".join(":".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for v in value)
    return str(value)


def _parameters(given: dict[str, object]) -> commands.Parameters:
    return commands.Parameters([f"{k}={_word(v)}" for k, v in given.items() if v is not None])


class Chain:
    """A (complex) cube with the programs as methods."""

    def __init__(self, cube: Cube | complexes.ComplexCube):
        self.cube = cube

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Chain:
        return cls(rsf.read(spark, path))

    @property
    def df(self) -> DataFrame:
        """(i1 .., v), or (i1 .., re, im) of complex samples."""
        return self.cube.long() if isinstance(self.cube, complexes.ComplexCube) else self.cube.long().df

    @property
    def meta(self):
        return self.cube.meta

    @property
    def shape(self) -> tuple[int, ...]:
        return self.cube.meta.shape

    def write(self, path: str, form: str = "") -> Chain:
        """Write the dataset; the chain goes on from what was written, so what comes before runs once."""
        rsf.write(self.cube, path, form)
        return Chain.read(self.cube.df.sparkSession, path)

    def map(self, value: Callable[[Column], Column]) -> Chain:
        """A function of the sample alone."""
        return Chain(self.cube.map(value))

    def cmplx(self, imaginary: Chain) -> Chain:
        return Chain(complexes.cmplx(self.cube, imaginary.cube))

    def _two(self, program: str, other: Chain, given: dict[str, object]) -> Chain:
        return Chain(commands.TWO[program](self.cube, other.cube, _parameters(given)))

    def __getattr__(self, program: str):
        if program in commands.ONE or program in commands.COMPLEX:
            one = commands.COMPLEX.get(program) or commands.ONE[program]
            return lambda **given: Chain(one(self.cube, _parameters(given)))
        if program in commands.TWO:
            return lambda other, **given: self._two(program, other, given)
        if program in commands.SAID:
            return lambda **given: commands.SAID[program](self.cube, _parameters(given))
        raise AttributeError(f"no program {program}")

    def __dir__(self):
        return sorted({*super().__dir__(), *commands.ONE, *commands.COMPLEX, *commands.TWO, *commands.SAID})

    def __add__(self, other: Chain) -> Chain:
        return self._two("add", other, {})

    def __sub__(self, other: Chain) -> Chain:
        return self._two("sub", other, {})

    def __mul__(self, other: Chain) -> Chain:
        return self._two("mul", other, {})

    def __truediv__(self, other: Chain) -> Chain:
        return self._two("div", other, {"zero": "raise"})
