"""Least-squares runs that can be cut at any step, resumed and explained.

A run writes its state to a folder that all executors share: the vectors of a
step (of the length of x) as tables, then its scalars and the record of all steps so far.  The record
is written last, so a step is there whole or not at all.  ``solve`` on a folder
that holds steps goes on from the last whole one, or from the step asked for,
and gives the steps an unbroken run would.  Steps that are no longer needed are
deleted.

Vectors of the length of the data are made once, at the start: a step is one pass
of the normal operator over a direction.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import solvers
from tracelake.operators.solvers import LinearOperator, combine

#: Columns of a run's record.
RECORD = "iteration int, objective double, data_term double, regularization_term double, residual_norm double, gradient_norm double, step_length double"


@dataclass
class Problem:
    """x with the least 0.5 |A x - b|^2 + 0.5 |weight L x|^2; without L the second term is 0.

    ``L`` is any operator on x: ``identity``, ``differences``, or ``diagonal``
    for weights of single places.
    """

    operator: LinearOperator
    data: DataFrame
    regularization: LinearOperator | None = None
    weight: float = 0.0

    def __post_init__(self):
        if not (self.weight >= 0 and math.isfinite(self.weight)):
            raise ValueError("a weight is finite and not below 0")
        if self.regularization and self.regularization.columns != self.operator.columns:
            raise ValueError("the regularization is of another number of places")

    def stacked(self) -> LinearOperator:
        if not self.regularization or not self.weight:
            return self.operator
        return solvers.stacked(self.operator, solvers.scaled(self.regularization, self.weight))

    def residual(self, x: DataFrame) -> DataFrame:
        """b - A x, and below it -weight L x."""
        return combine((1, self.data), (-1, self.stacked().forward(x)))

    def normal(self, x: DataFrame) -> DataFrame:
        """A* A x, with weight L in A."""
        own = self.operator.normal(x)
        if not self.regularization or not self.weight:
            return own
        return combine((1, own), (self.weight * self.weight, self.regularization.normal(x)))

    def regularization_term(self, x: DataFrame) -> float:
        if not self.regularization or not self.weight:
            return 0.0
        return (self.weight * solvers.norm(self.regularization.forward(x))) ** 2 / 2

    def terms(self, residual: DataFrame) -> tuple[float, float]:
        """Data and regularization term of the objective."""
        half = lambda where: F.coalesce(F.sum(F.when(where, F.col("v") * F.col("v"))), F.lit(0.0)) / 2
        own = F.col("i") < self.operator.rows
        return tuple(float(v) for v in residual.agg(half(own), half(~own)).first())

    def objective(self, x: DataFrame) -> float:
        return sum(self.terms(self.residual(x)))

    def gradient(self, x: DataFrame) -> DataFrame:
        """Of the objective at x."""
        return combine((-1, self.stacked().adjoint(self.residual(x))))


@dataclass
class Run:
    x: DataFrame
    iterations: int
    converged: bool
    #: gradient_tol, residual_tol, maxiter or breakdown (a direction that the operator takes to 0).
    stopping_reason: str
    #: A row for each step, the start being step 0.
    record: DataFrame

    def summary(self) -> dict:
        """What happened, without x: plain values."""
        rows = [r.asDict() for r in self.record.orderBy("iteration").collect()]
        return {"iterations": self.iterations, "converged": self.converged, "stopping_reason": self.stopping_reason, "records": rows}


class Folder:
    """Steps of a run, ``step-<k>``, each whole if it has a record."""

    VECTORS = ("x", "s", "p")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def _step(self, k: int) -> str:
        return f"{self.path}/step-{k:06d}"

    def steps(self) -> list[int]:
        if not self._files.exists(self._path(self.path)):
            return []
        found = [f.getPath().getName() for f in self._files.listStatus(self._path(self.path))]
        return sorted(int(n[5:]) for n in found if n.startswith("step-") and self._files.exists(self._path(f"{self.path}/{n}/record/_SUCCESS")))

    def write(self, k: int, vectors: dict[str, DataFrame], gamma: float, first: float, records: list[tuple]) -> dict[str, DataFrame]:
        """The vectors as written, read again; lineage ends there."""
        out = {}
        for name, v in vectors.items():
            v.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")).write.mode("overwrite").parquet(f"{self._step(k)}/{name}")
            out[name] = self.vector(k, name)
        rows = self.spark.createDataFrame([(*r, gamma, first) for r in records], RECORD + ", gamma double, first double")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self._step(k)}/record")
        return out

    def vector(self, k: int, name: str) -> DataFrame:
        return self.spark.read.schema("i long, v double").parquet(f"{self._step(k)}/{name}")

    def records(self, k: int) -> DataFrame:
        return self.spark.read.schema(RECORD + ", gamma double, first double").parquet(f"{self._step(k)}/record")

    def forget(self, steps: list[int]) -> None:
        for k in steps:
            self._files.delete(self._path(self._step(k)), True)


def solve(problem: Problem, folder: str, steps: int = 10, tol: float = 1e-6, x0: DataFrame | None = None, residual_tol: float = 0.0, keep: int = 2, start: int | None = None) -> Run:
    """Conjugate gradients for least squares, up to step number ``steps``.

    Stops when the gradient is below tol * max(its start, 1), or the residual at
    or below ``residual_tol``.  With steps in ``folder`` it goes on from the last
    (or from step ``start``, steps after which are deleted) and ``x0`` is not
    looked at.  The last ``keep`` steps stay, and step 0 with them.
    """
    a, spark = problem.stacked(), problem.data.sparkSession
    place = Folder(spark, folder)
    there = place.steps()
    if start is not None and start not in there:
        raise ValueError(f"{folder} has no step {start}, but {there}")
    if there:
        k = there[-1] if start is None else start
        place.forget([s for s in there if s > k])
        rows = sorted(place.records(k).collect(), key=lambda r: r["iteration"])
        records, gamma, first = [tuple(r)[:7] for r in rows], rows[-1]["gamma"], rows[-1]["first"]
        x, s, p = (place.vector(k, name) for name in Folder.VECTORS)
    else:
        x = problem.data.select("i", "v").limit(0) if x0 is None else x0
        r = problem.data if x0 is None else problem.residual(x0)
        p = solvers.cut(a.adjoint(r))
        k, gamma = 0, solvers.norm(p) ** 2
        first = math.sqrt(gamma)
        records = [_record(0, problem.terms(r), gamma, None)]
        x, s, p = place.write(0, {"x": x, "s": p, "p": p}, gamma, first, records).values()
    limit = tol * max(first, 1.0)
    reason = ""
    while not (reason := _reason(records[-1], limit, residual_tol, steps)):
        q = solvers.cut(problem.normal(p))
        size = solvers.dot(p, q)
        if size <= 0:
            reason = "breakdown"
            break
        alpha = gamma / size
        x, s = combine((1, x), (alpha, p)), solvers.cut(combine((1, s), (-alpha, q)))
        # |r|^2 falls by alpha gamma
        objective = records[-1][1] - alpha * gamma / 2
        gamma, before = solvers.norm(s) ** 2, gamma
        k += 1
        records.append(_record(k, _terms(problem, x, objective, records[0][1]), gamma, alpha))
        x, s, p = place.write(k, {"x": x, "s": s, "p": combine((1, s), (gamma / before, p))}, gamma, first, records).values()
        place.forget([s_ for s_ in place.steps() if 0 < s_ <= k - keep])
    return Run(x, k, reason in ("gradient_tol", "residual_tol"), reason, place.records(k).drop("gamma", "first"))


#: A part of the start's objective (or of the whole) below which a difference has too few digits left, and rows are gone through.
_SMALL = 1e-6


def _terms(problem: Problem, x: DataFrame, objective: float, start: float) -> tuple[float, float]:
    """Data and regularization term at x, of which the sum is known as what is left of the start's."""
    regularization = problem.regularization_term(x)
    data = objective - regularization
    return (data, regularization) if data > _SMALL * max(start, regularization) else problem.terms(problem.residual(x))


def _record(k: int, terms: tuple[float, float], gamma: float, alpha: float | None) -> tuple:
    data, regularization = terms
    return k, data + regularization, data, regularization, math.sqrt(2 * (data + regularization)), math.sqrt(gamma), alpha


def _reason(record: tuple, limit: float, residual_tol: float, steps: int) -> str:
    k, residual, gradient = record[0], record[4], record[5]
    if gradient <= limit:
        return "gradient_tol"
    if residual <= residual_tol:
        return "residual_tol"
    return "maxiter" if k >= steps else ""
