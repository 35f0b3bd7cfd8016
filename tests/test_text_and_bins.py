"""Text datasets by byte range, SEG-Y at places, and trace binning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_extra import cube, matrix
from tracelake import commands
from tracelake.cube import Axis
from tracelake.operators import headers
from tracelake.sources import rsf, segy


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1 << 20])
def test_words_of_ranges(tmp_path, size):
    data = b" 1.5\n\n-2e3 44444444444444444444   7\t8\r\n9"
    (tmp_path / "t").write_bytes(data)
    system, name = rsf._open(str(tmp_path / "t"))
    with system.open_input_file(name) as f:
        got = [rsf._words_of(f, a, a + size, len(data)) for a in range(0, len(data), size)]
    assert [w for _, part in got for w in part.split()] == data.split() and all(n == len(part.split()) for n, part in got)


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_text_reading(spark, tmp_path, size):
    x = np.random.default_rng(1).normal(size=(6, 5)) * 10.0 ** np.arange(-3, 3)[:, None]
    x[0, 0], x[1, 1], x[2, 2] = np.nan, np.inf, 1 / 3
    path = f"file://{tmp_path}/t"
    rsf.write(cube(spark, x, Axis(5, 0.5, 0.1), Axis(6)), path, "ascii_float")
    header = rsf.read_header(path)
    got = matrix(rsf._read_ascii(spark, path, header, rsf.meta_of(header), size))
    assert np.array_equal(got, x, equal_nan=True)  # every double comes back as it was
    assert not [p for p in tmp_path.iterdir() if p.name not in ("t", "t@")]
    (tmp_path / "t@").write_text("1 2 3\n")
    with pytest.raises(ValueError, match="fewer samples"):
        rsf._read_ascii(spark, path, header, rsf.meta_of(header), size)


def test_text_of_absent_traces(spark, tmp_path):
    c = cube(spark, np.arange(12.0).reshape(4, 3) + 1)
    sparse = c.derive(c.df.where("i2 in (0, 3)"))
    rsf.write(sparse, f"file://{tmp_path}/s", "ascii_float")
    want = np.where(np.isin(np.arange(4), [0, 3])[:, None], np.arange(12.0).reshape(4, 3) + 1, 0)
    assert np.array_equal(matrix(rsf.read(spark, f"file://{tmp_path}/s")), want)
    assert len((tmp_path / "s@").read_text().splitlines()) == 4


def test_segy_places(spark, tmp_path):
    x = np.arange(20.0).reshape(5, 4)
    df = spark.createDataFrame([(10 * k + 7, x[k].tolist(), k) for k in range(5)][::-1], "trace long, samples array<double>, cdp int")
    path = f"file://{tmp_path}/a.sgy"
    segy.write(df, path, 4, 2000)
    got = segy.read(spark, path)[0].orderBy("trace").collect()
    assert [r["cdp"] for r in got] == list(range(5)) and np.array_equal([r["samples"] for r in got], x)
    assert [p.name for p in tmp_path.iterdir()] == ["a.sgy"]
    segy.write(df.limit(0), f"file://{tmp_path}/b.sgy", 4, 2000)
    assert segy.layout(f"file://{tmp_path}/b.sgy").traces == 0


def _grid(c):
    out = np.zeros(c.meta.shape[::-1])
    for r in c.df.collect():
        out[tuple(r[f"i{k}"] for k in range(c.rank, 1, -1))] = r["samples"]
    return out


def test_trace_binning(spark, tmp_path):
    x = np.array([[1.0, 1.5], [2.0, 2.5], [3.0, 3.5], [4.0, 4.5], [5.0, 5.5]])
    c = cube(spark, x)
    keys = [(0, 0), (1, 0), (0, 1), (3, 3), (1, 0)]
    table = spark.createDataFrame([(t, a, b, float(t % 2), 0.25 * t) for t, (a, b) in enumerate(keys)], "trace long, a int, b int, c double, d double")
    got = headers.bin_traces(c, table, ["a", "b"], [(0, 1), (0, 1)])
    want = np.zeros((2, 2, 2))
    want[0, 0], want[0, 1], want[1, 0] = x[0], x[4], x[2]  # the last of two in a cell stays
    assert np.array_equal(_grid(got), want) and got.df.count() == 3 and headers.filled(got).df.count() == 4
    assert np.array_equal(_grid(headers.filled(got)), want) and got.meta.axes[1].o == 0
    free = headers.bin_traces(c, table, ["a", "b"])
    assert free.meta.shape == (2, 4, 4) and np.array_equal(_grid(free)[3, 3], x[3])
    three = headers.bin_traces(c, table, ["a", "b", "c"])
    assert three.meta.shape == (2, 4, 4, 2) and np.array_equal(_grid(three)[1, 0, 1], x[1] * 0) is False
    low = headers.bin_traces(c, table, ["a", "b"], [(-2, None), (None, 0)])
    assert low.meta.shape == (2, 6, 1) and low.meta.axes[1].o == -2 and np.array_equal(_grid(low)[0, 3], x[4])
    for bad, words in ((dict(keys=["a", "d"]), "integer"), (dict(keys=["a", "b"], bounds=[(2, 1), (0, 1)]), "order"), (dict(keys=["a", "x"]), "keys")):
        with pytest.raises(ValueError, match=words):
            headers.bin_traces(c, table, **bad)
    with pytest.raises(ValueError, match="row count"):
        headers.bin_traces(c, table.where("trace < 4"), ["a", "b"])
    with pytest.raises(ValueError, match="integer"):
        headers.bin_traces(c, table.withColumn("a", F.when(F.col("a") < 3, F.col("a"))), ["a", "b"])
    here = lambda name: f"file://{tmp_path}/{name}"
    rsf.write(c, here("x"))
    rsf.write_table(table, ["a", "b", "c"], here("h"), "trace")
    commands.run(spark, "intbin", [here("x"), here("out"), f"head={here('h')}", "xmin=0", "xmax=1", "ymin=0", "ymax=1"])
    assert np.array_equal(_grid(rsf.read(spark, here("out"))), want)
    commands.run(spark, "intbin3", [here("x"), here("out3"), f"head={here('h')}", "xkey=1", "ykey=0"])
    assert rsf.read(spark, here("out3")).meta.shape == (2, 4, 4, 2)
    with pytest.raises(ValueError, match="keys"):
        commands.run(spark, "intbin3", [here("x"), here("out4"), f"head={here('h')}", "zkey=3"])
