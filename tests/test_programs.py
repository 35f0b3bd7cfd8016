"""Programs on complex systems, dot tests, coordinate grids and SEG-Y headers."""

import numpy as np
import pytest

from tests.test_extra import cube, matrix
from tests.test_files import complex_cube
from tracelake import commands
from tracelake.cube import Axis
from tracelake.sources import rsf, segy


@pytest.fixture
def here(tmp_path):
    return lambda name: f"file://{tmp_path}/{name}"


def test_complex_systems(spark, here):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(5, 3)) + 1j * rng.normal(size=(5, 3))
    y = rng.normal(size=5) + 1j * rng.normal(size=5)
    rsf.write(complex_cube(spark, m), here("m"), "native_double_complex")
    rsf.write(complex_cube(spark, y[None]), here("y"), "native_double_complex")
    said = commands.run(spark, "cconjgrad", [here("m"), here("y"), here("x"), "niter=8", "tol=1e-10"])
    row = rsf.read(spark, here("x")).df.first()
    assert "converged=True" in said and np.allclose(np.array(row["re"]) + 1j * np.array(row["im"]), np.linalg.lstsq(m, y, rcond=None)[0], atol=1e-5)
    assert "passed=True" in commands.run(spark, "cdottest", [here("m"), "seed=3"])
    assert "passed=True" in commands.run(spark, "cdottest", ["op=identity", "n=4"])


def test_dot_test(spark, here):
    rsf.write(cube(spark, np.random.default_rng(2).normal(size=(4, 6))), here("m"), "native_double")
    assert "passed=True" in commands.run(spark, "dottest", [here("m")])
    assert "passed=True" in commands.run(spark, "dottest", ["op=identity", "n=7"])


def test_coordinate_grid(spark, here):
    commands.run(spark, "math", [here("g"), "n1=4", "o1=0.5", "d1=0.25", "n2=3", "o2=10", "d2=10", "output=x1+x2"])
    got = rsf.read(spark, here("g"))
    assert got.meta.axes[1] == Axis(3, 10.0, 10.0) and np.allclose(matrix(got), (0.5 + 0.25 * np.arange(4))[None] + (10 + 10 * np.arange(3))[:, None])


def test_segy_headers(spark, here):
    x = np.arange(12.0).reshape(4, 3)
    rsf.write(cube(spark, x, Axis(3, 0.0, 0.002), Axis(4)), here("d"))
    heads = spark.createDataFrame([(k, 100.0 + k, -5.0 * k, 1.0) for k in range(4)], "trace long, cdp double, offset double, other double")
    rsf.write_table(heads, ["cdp", "offset", "other"], here("h"), "trace")
    commands.run(spark, "segywrite", [here("d"), here("a.sgy"), f"head={here('h')}", "endian=little", "format=3"])
    rows = segy.header_table(spark, here("a.sgy"), "cdp", "offset", "dt").orderBy("trace").collect()
    assert [tuple(r) for r in rows] == [(k, 100 + k, -5 * k, 2000) for k in range(4)]
    commands.run(spark, "segyread", [here("a.sgy"), here("b"), f"headers={here('csv')}"])
    table = spark.read.option("header", True).csv(here("csv"))
    assert np.array_equal(matrix(rsf.read(spark, here("b"))), x) and len(table.columns) == 92
    assert sorted((int(r["trace"]), int(r["cdp"])) for r in table.collect()) == [(k, 100 + k) for k in range(4)]
