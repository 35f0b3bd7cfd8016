"""Linear operators on distributed vectors, dot tests, and least-squares solvers.

A vector is a DataFrame (i, v), absent places being 0.  Operators are plans;
solvers are loops on the driver that keep scalars only, and cut the lineage of
their vectors at each step with a checkpoint in the shared folder.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_LOCAL: dict[int, str] = {}


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; a temporary folder serves local sessions only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="tracelake-"))


def cut(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def combine(*terms: tuple[float, DataFrame]) -> DataFrame:
    """Sum of factor times vector."""
    parts = [v.select("i", (F.col("v") * float(a)).alias("v")) for a, v in terms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i").agg(F.sum("v").alias("v"))


def dot(a: DataFrame, b: DataFrame) -> float:
    row = a.join(b.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()
    return float(row[0] or 0.0)


def norm(a: DataFrame) -> float:
    return math.sqrt(float(a.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0))


class LinearOperator:
    """``forward`` takes vectors of ``columns`` places to ``rows`` places; ``adjoint`` goes back."""

    rows: int
    columns: int

    def forward(self, x: DataFrame) -> DataFrame:
        raise NotImplementedError

    def adjoint(self, y: DataFrame) -> DataFrame:
        raise NotImplementedError

    def normal(self, x: DataFrame) -> DataFrame:
        """``adjoint`` after ``forward``."""
        return self.adjoint(self.forward(x))


@dataclass
class Matrix(LinearOperator):
    """Sparse matrix: entries (row, col, value).

    ``single`` tells that no row has two entries: then A x needs no sums, and
    A* A is a weight for each column, added up once.
    """

    entries: DataFrame
    rows: int
    columns: int
    single: bool = False
    _squares: DataFrame | None = field(default=None, init=False, repr=False)

    def _times(self, vector: DataFrame, over: str, to: str) -> DataFrame:
        joined = self.entries.join(vector.withColumnRenamed("i", over), over)
        return joined.groupBy(F.col(to).alias("i")).agg(F.sum(F.col("value") * F.col("v")).alias("v"))

    def forward(self, x: DataFrame) -> DataFrame:
        if self.single:
            return self.entries.join(x.withColumnRenamed("i", "col"), "col").select(F.col("row").alias("i"), (F.col("value") * F.col("v")).alias("v"))
        return self._times(x, "col", "row")

    def adjoint(self, y: DataFrame) -> DataFrame:
        return self._times(y, "row", "col")

    def normal(self, x: DataFrame) -> DataFrame:
        if not self.single:
            return super().normal(x)
        if self._squares is None:
            self._squares = cut(self.entries.groupBy("col").agg(F.sum(F.col("value") * F.col("value")).alias("value")))
        return self._squares.join(x.withColumnRenamed("i", "col"), "col").select(F.col("col").alias("i"), (F.col("value") * F.col("v")).alias("v"))


@dataclass
class Custom(LinearOperator):
    """Forward and adjoint of the caller's own."""

    rows: int
    columns: int
    to: Callable[[DataFrame], DataFrame]
    back: Callable[[DataFrame], DataFrame]

    def forward(self, x: DataFrame) -> DataFrame:
        return self.to(x)

    def adjoint(self, y: DataFrame) -> DataFrame:
        return self.back(y)


def identity(n: int) -> LinearOperator:
    return Custom(n, n, lambda x: x, lambda y: y)


def scaled(a: LinearOperator, factor: float) -> LinearOperator:
    return Custom(a.rows, a.columns, lambda x: combine((factor, a.forward(x))), lambda y: combine((factor, a.adjoint(y))))


def added(a: LinearOperator, b: LinearOperator) -> LinearOperator:
    if (a.rows, a.columns) != (b.rows, b.columns):
        raise ValueError("shapes differ")
    return Custom(a.rows, a.columns, lambda x: combine((1, a.forward(x)), (1, b.forward(x))), lambda y: combine((1, a.adjoint(y)), (1, b.adjoint(y))))


def composed(a: LinearOperator, b: LinearOperator) -> LinearOperator:
    """a after b."""
    if a.columns != b.rows:
        raise ValueError("shapes do not meet")
    return Custom(a.rows, b.columns, lambda x: a.forward(b.forward(x)), lambda y: b.adjoint(a.adjoint(y)))


def stacked(a: LinearOperator, b: LinearOperator) -> LinearOperator:
    """Rows of b below those of a."""
    if a.columns != b.columns:
        raise ValueError("shapes do not meet")
    moved = lambda v, by: v.select((F.col("i") + by).alias("i"), "v")
    return Custom(
        a.rows + b.rows,
        a.columns,
        lambda x: a.forward(x).unionByName(moved(b.forward(x), a.rows)),
        lambda y: combine((1, a.adjoint(y.where(F.col("i") < a.rows))), (1, b.adjoint(moved(y.where(F.col("i") >= a.rows), -a.rows)))),
    )


def diagonal(weights: DataFrame, n: int) -> LinearOperator:
    """Multiplies place i by the weight of i, which must not be 0."""
    times = lambda x: x.join(weights.select("i", F.col("v").alias("w")), "i").select("i", (F.col("v") * F.when(F.col("w") == 0, F.raise_error(F.lit("a weight of 0"))).otherwise(F.col("w"))).alias("v"))
    return Custom(n, n, times, times)


def differences(n: int, order: int = 1) -> LinearOperator:
    """First ([-1, 1]) or second ([1, -2, 1]) differences where all their places exist."""
    weights = {1: (-1.0, 1.0), 2: (1.0, -2.0, 1.0)}[order]
    rows = n - order

    def spread(v: DataFrame, sign: int, limit: int) -> DataFrame:
        entries = F.explode(F.array(*[F.struct((F.col("i") + sign * k).alias("i"), (F.col("v") * w).alias("v")) for k, w in enumerate(weights)])).alias("e")
        return v.select(entries).select("e.*").where(F.col("i").between(0, limit - 1)).groupBy("i").agg(F.sum("v").alias("v"))

    return Custom(rows, n, lambda x: spread(x, -1, rows), lambda y: spread(y, 1, n))


@dataclass
class Solution:
    x: DataFrame
    iterations: int
    converged: bool
    #: Norm of what the stopping rule watches, at the start and after each step.
    history: list[float] = field(default_factory=list)


def _zero(like: DataFrame) -> DataFrame:
    return like.select("i", "v").limit(0)


def conjugate_gradient(a: LinearOperator, b: DataFrame, x0: DataFrame | None = None, steps: int = 10, tol: float = 1e-6, damp: float = 0.0) -> Solution:
    """(A + damp^2) x = b for symmetric positive A; stops at a residual of tol * max(|b|, 1).  No curvature raises."""
    apply = lambda v: combine((1, a.forward(v)), (damp * damp, v)) if damp else a.forward(v)
    x = _zero(b) if x0 is None else x0
    r = cut(b if x0 is None else combine((1, b), (-1, apply(x0))))
    p, rho, limit = r, dot(r, r), tol * max(norm(b), 1.0)
    history, k = [math.sqrt(rho)], 0
    while history[-1] > limit and k < steps:
        q = cut(apply(p))
        curve = dot(p, q)
        if curve <= 0:
            raise ValueError("the operator is not positive along a direction")
        alpha = rho / curve
        x, r = cut(combine((1, x), (alpha, p))), cut(combine((1, r), (-alpha, q)))
        rho, before = dot(r, r), rho
        p = cut(combine((1, r), (rho / before, p)))
        history.append(math.sqrt(rho))
        k += 1
    return Solution(x, k, history[-1] <= limit, history)


def cgnr(a: LinearOperator, b: DataFrame, x0: DataFrame | None = None, steps: int = 10, tol: float = 1e-6, damp: float = 0.0) -> Solution:
    """Conjugate gradients on the normal equations."""
    normal = Custom(a.columns, a.columns, lambda v: a.adjoint(a.forward(v)), lambda v: a.adjoint(a.forward(v)))
    return conjugate_gradient(normal, cut(a.adjoint(b)), x0, steps, tol, damp)


def cgls(a: LinearOperator, b: DataFrame, x0: DataFrame | None = None, steps: int = 10, tol: float = 1e-6, damp: float = 0.0, preconditioner: LinearOperator | None = None) -> Solution:
    """Least squares of A x - b, and of damp x; stops when the gradient is below tol * max(its start, 1).

    A right preconditioner M solves for z with x = M z.
    """
    if damp:
        a = stacked(a, scaled(identity(a.columns), damp))
    if preconditioner:
        a = composed(a, preconditioner)
    if preconditioner and x0 is not None:
        raise ValueError("a start needs the inverse of the preconditioner")
    x = _zero(b) if x0 is None else x0
    r = cut(b if x0 is None else combine((1, b), (-1, a.forward(x0))))
    s = cut(a.adjoint(r))
    p, gamma = s, dot(s, s)
    history, k = [math.sqrt(gamma)], 0
    limit = tol * max(history[0], 1.0)
    while history[-1] > limit and k < steps:
        q = cut(a.forward(p))
        size = dot(q, q)
        if not size:
            break
        alpha = gamma / size
        x, r = cut(combine((1, x), (alpha, p))), cut(combine((1, r), (-alpha, q)))
        s = cut(a.adjoint(r))
        gamma, before = dot(s, s), gamma
        p = cut(combine((1, s), (gamma / before, p)))
        history.append(math.sqrt(gamma))
        k += 1
    return Solution(preconditioner.forward(x) if preconditioner else x, k, history[-1] <= limit, history)


def lsqr(a: LinearOperator, b: DataFrame, x0: DataFrame | None = None, steps: int = 10, tol: float = 1e-6, damp: float = 0.0) -> Solution:
    """Golub-Kahan bidiagonalisation for a correction to x0; stops at a residual of tol * max(its start, 1) or when a direction ends."""
    if damp:
        a = stacked(a, scaled(identity(a.columns), damp))
    start = b if x0 is None else combine((1, b), (-1, a.forward(x0)))
    beta = norm(start)
    history, x, k = [beta], _zero(b) if x0 is None else x0, 0
    limit = tol * max(beta, 1.0)
    if beta <= limit:
        return Solution(x, 0, True, history)
    u = cut(combine((1 / beta, start)))
    v = cut(a.adjoint(u))
    alpha = norm(v)
    if not alpha:
        return Solution(x, 0, False, history)
    v = cut(combine((1 / alpha, v)))
    w, phi, rho_bar = v, beta, alpha
    while history[-1] > limit and k < steps:
        u = cut(combine((1, a.forward(v)), (-alpha, u)))
        beta = norm(u)
        u = cut(combine((1 / beta, u))) if beta > 1e-14 else u
        back = cut(combine((1, a.adjoint(u)), (-beta, v))) if beta > 1e-14 else v
        alpha = norm(back) if beta > 1e-14 else 0.0
        rho = math.hypot(rho_bar, beta)
        cos, sin = rho_bar / rho, beta / rho
        x = cut(combine((1, x), (cos * phi / rho, w)))
        phi *= sin
        history.append(abs(phi))
        k += 1
        if alpha <= 1e-14 or beta <= 1e-14:
            break
        v = cut(combine((1 / alpha, back)))
        w = cut(combine((1, v), (-sin * alpha / rho, w)))
        rho_bar = -cos * alpha
    return Solution(x, k, history[-1] <= limit, history)


def dot_test(spark, a: LinearOperator, seed: int = 0, rtol: float = 1e-5, atol: float = 1e-6) -> tuple[float, float, bool]:
    """(<A x, y>, <x, A* y>, whether they agree) for vectors drawn from a hash of the place."""
    drawn = lambda n, salt: spark.range(n).select(F.col("id").alias("i"), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(2001)) / 1000.0 - 1).alias("v"))
    x, y = drawn(a.columns, 1), drawn(a.rows, 2)
    left, right = dot(a.forward(x), y), dot(x, a.adjoint(y))
    return left, right, abs(left - right) <= atol + rtol * max(abs(left), abs(right))
