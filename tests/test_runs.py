"""Least-squares runs: cut, resumed, explained."""

import numpy as np
import pytest

from tracelake.operators import runs, solvers


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(6)
    a, y = rng.normal(size=(12, 5)), rng.normal(size=12)
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i, j in np.ndindex(a.shape)], "row long, col long, value double")
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, v double")
    return a, y, solvers.Matrix(entries, 12, 5), data


def _values(x, n=5):
    out = np.zeros(n)
    for r in x.collect():
        out[r["i"]] = r["v"]
    return out


def test_a_run_cut_and_resumed_is_an_unbroken_one(spark, system, tmp_path):
    a, y, matrix, data = system
    problem = runs.Problem(matrix, data, solvers.differences(5), 0.7)
    whole = runs.solve(problem, f"file://{tmp_path}/a", 8, 1e-10)
    first = runs.solve(problem, f"file://{tmp_path}/b", 2, 1e-10)
    assert (first.iterations, first.converged, first.stopping_reason) == (2, False, "maxiter")
    again = runs.solve(problem, f"file://{tmp_path}/b", 8, 1e-10)
    full = np.vstack([a, 0.7 * np.diff(np.eye(5), axis=0)])
    want = np.linalg.lstsq(full, np.concatenate([y, np.zeros(4)]), rcond=None)[0]
    for run in (whole, again):
        assert run.converged and run.stopping_reason == "gradient_tol" and np.allclose(_values(run.x), want)
    one, two = whole.summary(), again.summary()
    assert one["iterations"] == two["iterations"] and len(one["records"]) == one["iterations"] + 1
    for p, q in zip(one["records"], two["records"], strict=True):
        assert p["iteration"] == q["iteration"] and all(np.isclose(p[c], q[c]) for c in p if p[c] is not None and c != "gradient_norm")
    objective = [r["objective"] for r in one["records"]]
    assert objective == sorted(objective, reverse=True) and one["records"][0]["step_length"] is None
    last = one["records"][-1]
    assert np.isclose(last["objective"], 0.5 * np.sum((full @ want - np.concatenate([y, np.zeros(4)])) ** 2)) and np.isclose(last["data_term"] + last["regularization_term"], last["objective"])
    assert np.isclose(problem.objective(whole.x), last["objective"]) and np.abs(_values(problem.gradient(whole.x))).max() < 1e-8


def test_any_kept_step_is_a_start(spark, system, tmp_path):
    _, _, matrix, data = system
    problem, folder = runs.Problem(matrix, data), f"file://{tmp_path}/c"
    done = runs.solve(problem, folder, 4, 0.0, keep=3)
    place = runs.Folder(spark, folder)
    want = _values(done.x)
    assert place.steps() == [0, 2, 3, 4] and done.iterations == 4
    back = runs.solve(problem, folder, 4, 0.0, start=2)
    assert np.allclose(_values(back.x), want) and back.record.count() == 5
    with pytest.raises(ValueError, match="no step"):
        runs.solve(problem, folder, 4, start=1)
    # a step without its record was cut short and doesn't count
    place.forget([4])
    data.write.parquet(f"{folder}/step-000004/x")
    assert place.steps() == [0, 3]  # two were kept the second time
    assert np.allclose(_values(runs.solve(problem, folder, 4, 0.0).x), want)


def test_reasons(spark, system, tmp_path):
    a, y, matrix, data = system
    none = runs.solve(runs.Problem(matrix, data.limit(0)), f"file://{tmp_path}/d", 5)
    assert none.stopping_reason == "gradient_tol" and none.iterations == 0 and none.x.count() == 0
    exact = spark.createDataFrame([(i, float(v)) for i, v in enumerate(a @ np.arange(5.0))], "i long, v double")
    near = runs.solve(runs.Problem(matrix, exact), f"file://{tmp_path}/e", 9, 0.0, residual_tol=1e-6)
    assert near.stopping_reason == "residual_tol" and near.converged and np.allclose(_values(near.x), np.arange(5.0))
    start = runs.solve(runs.Problem(matrix, exact), f"file://{tmp_path}/f", 9, 1e-9, x0=near.x)
    assert start.iterations <= 1
    with pytest.raises(ValueError):
        runs.Problem(matrix, data, solvers.identity(4), 1.0)
    with pytest.raises(ValueError):
        runs.Problem(matrix, data, solvers.identity(5), -1.0)


def test_diagonal_regularization(spark, system, tmp_path):
    a, y, matrix, data = system
    weights = np.array([1.0, 2.0, 0.5, 3.0, 1.5])
    table = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "i long, v double")
    run = runs.solve(runs.Problem(matrix, data, solvers.diagonal(table, 5), 2.0), f"file://{tmp_path}/g", 10, 1e-10)
    assert np.allclose(_values(run.x), np.linalg.solve(a.T @ a + 4 * np.diag(weights**2), a.T @ y))


def test_rows_of_one_entry(spark, tmp_path, monkeypatch):
    """Steps go through the rows once, however many there are, and agree with those of a general matrix."""
    rng = np.random.default_rng(2)
    cols, y, values = rng.integers(0, 6, 60), rng.normal(size=60), rng.uniform(0.5, 2.0, 60)
    entries = spark.createDataFrame([(i, int(c), float(w)) for i, (c, w) in enumerate(zip(cols, values, strict=True))], "row long, col long, value double")
    data = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "i long, v double")
    passes = []
    forward = solvers.Matrix.forward
    monkeypatch.setattr(solvers.Matrix, "forward", lambda self, x: passes.append(1) or forward(self, x))
    one = runs.solve(runs.Problem(solvers.Matrix(entries, 60, 6, single=True), data, solvers.identity(6), 3.0), f"file://{tmp_path}/h", 12, 1e-10)
    assert not passes and one.converged
    two = runs.solve(runs.Problem(solvers.Matrix(entries, 60, 6), data, solvers.identity(6), 3.0), f"file://{tmp_path}/k", 12, 1e-10)
    a = np.zeros((60, 6))
    a[np.arange(60), cols] = values
    want = np.linalg.solve(a.T @ a + 9 * np.eye(6), a.T @ y)
    assert np.allclose(_values(one.x, 6), want) and np.allclose(_values(two.x, 6), want)
    for p, q in zip(one.summary()["records"], two.summary()["records"], strict=True):
        assert np.isclose(p["objective"], q["objective"]) and np.isclose(p["data_term"], q["data_term"])
    last = one.summary()["records"][-1]
    assert np.isclose(last["data_term"], 0.5 * np.sum((a @ want - y) ** 2)) and np.isclose(last["regularization_term"], 4.5 * np.sum(want**2))
