"""Planned sources: ranges, pruning and results."""

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from tests.test_extra import cube
from tracelake.cube import Axis
from tracelake.sources import planned, rsf, segy


@pytest.fixture
def files(spark, tmp_path):
    x = np.arange(300 * 6, dtype=float).reshape(300, 6)
    df = spark.createDataFrame([(k, x[k].tolist(), k % 7, -k) for k in range(300)], "trace long, samples array<double>, cdp int, offset int")
    segy.write(df, f"file://{tmp_path}/a.sgy", 6, 2000)
    rsf.write(cube(spark, x.reshape(10, 30, 6), Axis(6), Axis(30), Axis(10)), f"file://{tmp_path}/a", "native_double")
    return f"file://{tmp_path}/a.sgy", f"file://{tmp_path}/a", x


def _read_by(reader, *filters):
    left = list(reader.pushFilters(list(filters)))
    return left, [(p.start, p.stop) for p in reader.partitions()]


def test_filters_become_ranges(files):
    sgy, dataset, _ = files
    size = segy.HEAD + 6 * 4
    make = lambda: planned._SegyReader({"path": sgy, "partition_bytes": str(100 * size)}, StructType.fromDDL("trace long, cdp int"))
    at = ("trace",)
    assert _read_by(make()) == ([], [(0, 100), (100, 200), (200, 300)])
    assert _read_by(make(), ds.GreaterThanOrEqual(at, 150), ds.LessThan(at, 260)) == ([], [(150, 250), (250, 260)])
    assert _read_by(make(), ds.In(at, (5, 6, 299, None)), ds.IsNotNull(at)) == ([], [(5, 6), (6, 7), (299, 300)])
    assert _read_by(make(), ds.EqualTo(at, 400)) == ([], [(0, 0)])
    assert _read_by(make(), ds.LessThanOrEqual(at, 3), ds.GreaterThan(at, 1)) == ([], [(2, 4)])
    other = ds.EqualTo(("cdp",), 3)
    assert _read_by(make(), other, ds.EqualTo(at, 9)) == ([other], [(9, 10)])
    three = planned._DatasetReader({"path": dataset}, StructType.fromDDL("i3 long"))
    part = ds.EqualTo(("i2",), 4)
    assert _read_by(three, ds.EqualTo(("i3",), 2), part) == ([part], [(60, 90)])


def test_reading(spark, files):
    sgy, dataset, x = files
    got = planned.segy_traces(spark, sgy).where("trace between 20 and 24 and cdp <> 1").orderBy("trace").collect()
    assert [r["trace"] for r in got] == [20, 21, 23, 24] and all(np.array_equal(r["samples"], x[r["trace"]]) and r["offset"] == -r["trace"] for r in got)
    assert len(got[0].asDict()) == 93
    plan = planned.segy_traces(spark, sgy, ["trace", "offset"], partition_bytes=2640).where("trace >= 290")
    assert plan.rdd.getNumPartitions() == 1 and plan.count() == 10 and plan.columns == ["trace", "offset"]
    rows = planned.dataset_traces(spark, dataset).where("i3 = 4 and i2 < 2").orderBy("trace").collect()
    assert [(r["trace"], r["i2"], r["i3"]) for r in rows] == [(120, 0, 4), (121, 1, 4)] and np.array_equal(rows[1]["samples"], x[121])
    assert planned.dataset_traces(spark, dataset, ["i2"]).count() == 300


def test_long_traces_are_skipped(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(k, [float(k)] * 40, 5 * k) for k in range(9)], "trace long, samples array<double>, cdp int")
    path = f"file://{tmp_path}/b.sgy"
    segy.write(df, path, 40, 1000)
    reader = planned._SegyReader({"path": path}, StructType.fromDDL("trace long, cdp int"))
    read = []
    monkeypatch.setattr(planned, "SKIP", 100)

    class Counting:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, n, at):
            read.append(n)
            return self.f.read_at(n, at)

    opened = rsf._open
    monkeypatch.setattr(rsf, "_open", lambda p: (type("S", (), {"open_input_file": lambda self, name: Counting(opened(p)[0].open_input_file(name))})(), opened(p)[1]))
    got = pa_rows(reader.read(planned.Traces(2, 5)))
    assert got == [(2, 10), (3, 15), (4, 20)] and read == [segy.HEAD] * 3


def pa_rows(batches):
    return [tuple(r.values()) for b in batches for r in b.to_pylist()]


def test_errors(spark, files):
    sgy, dataset, _ = files
    with pytest.raises(Exception, match="no header words"):
        planned.segy_traces(spark, sgy, ["trace", "nonsense"]).count()
    with pytest.raises(Exception, match="no columns"):
        planned.dataset_traces(spark, dataset, ["i9"]).count()
    rsf.convert(spark, dataset, dataset + ".text", "ascii_float")
    with pytest.raises(Exception, match="whole traces"):
        planned.dataset_traces(spark, dataset + ".text").count()
