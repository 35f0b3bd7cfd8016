"""Cubes in text-header files with a binary payload beside them.

The header is a list of ``key=value`` words, the last value of a key counting;
``in=`` names the payload.  Tasks read byte ranges of whole traces through
``pyarrow.fs``.  In a mounted file system tasks write traces at their places in
one file; elsewhere they leave a part for each range of traces, and the parts
are joined in order, a block at a time.
"""

from __future__ import annotations

import os
import posixpath
import re
import shlex
import uuid
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.cube import Axis, Cube, Meta
from tracelake.operators.complexes import ComplexCube
from tracelake.operators.solvers import cut as cut_lineage

# Payload formats.
FORMATS = {
    "native_float": "<f4",
    "native_double": "<f8",
    "native_int": "<i4",
    "xdr_float": ">f4",
    "xdr_double": ">f8",
    "xdr_int": ">i4",
}
#: Complex formats, as pairs of real ones.
COMPLEX = {"native_complex": "native_float", "native_double_complex": "native_double", "xdr_complex": "xdr_float", "xdr_double_complex": "xdr_double"}
BLOCK = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def parse_header(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in text.splitlines():
        for word in shlex.split(line, comments=True):
            key, eq, value = word.partition("=")
            if eq and re.fullmatch(r"\w+", key):
                found[key] = value
    return found


def read_header(path: str) -> dict[str, str]:
    system, name = _open(path)
    with system.open_input_stream(name) as f:
        return parse_header(f.read().decode("utf-8"))


def meta_of(header: dict[str, str]) -> Meta:
    """Axes up to the last ``n#`` of the header; other words are attributes."""
    rank = 0
    while f"n{rank + 1}" in header:
        rank += 1
    if not rank:
        raise ValueError("the header has no n1")
    axes = tuple(Axis(int(header[f"n{k}"]), float(header.get(f"o{k}", 0)), float(header.get(f"d{k}", 1)), header.get(f"label{k}", ""), header.get(f"unit{k}", "")) for k in range(1, rank + 1))
    rest = {k: v for k, v in header.items() if not re.fullmatch(r"(n|o|d|label|unit)\d+", k)}
    return Meta(axes, rest)


def read(spark: SparkSession, path: str, partition_bytes: int = 64 << 20) -> Cube | ComplexCube:
    """The file as a (complex) cube in trace layout; a payload shorter than its axes raises."""
    header = read_header(path)
    meta = meta_of(header)
    kind = header.get("data_format", "native_float")
    if kind in COMPLEX:
        flat = replace(meta, axes=(Axis(2 * meta.axes[0].n), *meta.axes[1:]))
        pairs = _read_binary(spark, path, header, flat, COMPLEX[kind], partition_bytes).df
        half = lambda k: F.filter("samples", lambda v, i: i % 2 == k)
        return ComplexCube(pairs.withColumns({"re": half(0), "im": half(1)}).drop("samples"), meta)
    if kind == "ascii_float":
        return _read_ascii(spark, path, header, meta)
    if kind not in FORMATS:
        raise ValueError(f"data_format {kind}")
    return _read_binary(spark, path, header, meta, kind, partition_bytes)


def _read_binary(spark: SparkSession, path: str, header: dict[str, str], meta: Meta, kind: str, partition_bytes: int) -> Cube:
    payload = _payload(path, header)
    n1, traces, item = meta.axes[0].n, meta.leftsize(1), np.dtype(FORMATS[kind]).itemsize
    system, name = _open(payload)
    if system.get_file_info(name).size < n1 * traces * item:
        raise ValueError(f"{payload} holds fewer samples than its axes")
    step = max(1, BLOCK // (n1 * item))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _open(payload)
        with files.open_input_file(at) as f:
            for batch in batches:
                for start in batch.column(0).to_pylist():
                    n = min(step, traces - start)
                    values = np.frombuffer(f.read_at(n * n1 * item, start * n1 * item), FORMATS[kind]).astype(np.float64)
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * n1, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + n)), pa.ListArray.from_arrays(ends, pa.array(values))], names=["at", "samples"])

    parts = max(1, min(traces, -(-traces * n1 * item // partition_bytes)))
    rows = spark.range(0, traces, step, parts).mapInArrow(run, "at long, samples array<double>")
    return Cube(_keyed(rows, meta), meta, "trace")


def _payload(path: str, header: dict[str, str]) -> str:
    where = header.get("in", "")
    if where in ("", "stdin", "stdout"):
        raise ValueError("the header names no payload file")
    return where if "://" in where else posixpath.join(posixpath.dirname(path), where)


def _keyed(rows: DataFrame, meta: Meta) -> DataFrame:
    keys, step = [], 1
    for k, a in enumerate(meta.axes[1:], 2):
        keys.append((F.floor(F.col("at") / step) % a.n).cast("long").alias(f"i{k}"))
        step *= a.n
    return rows.select(*(keys or [F.lit(0).cast("long").alias("i2")]), "samples")


#: Bytes of a text range; white space between the numbers of a text.
TEXT_RANGE, SPACES = 8 << 20, b" \t\n\r\x0b\x0c"
_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def _words_of(f, start: int, stop: int, size: int) -> tuple[int, bytes]:
    """(count, bytes) of the words that start in a byte range of a text; the last one whole, wherever it ends."""
    before = f.read_at(1, start - 1) if start else b" "
    data = f.read_at(min(stop, size) - start, start)
    at = np.frombuffer(before + data, np.uint8)
    blank = _IS_SPACE[at]
    count = int((blank[:-1] & ~blank[1:]).sum())
    if not blank[0]:  # the end of a word that started before
        space = np.flatnonzero(blank)
        data = data[space[0] - 1 :] if len(space) else b""
    while data and stop < size and data[-1] not in SPACES:
        more = f.read_at(min(4096, size - stop), stop)
        ends = np.flatnonzero(_IS_SPACE[np.frombuffer(more, np.uint8)])
        data, stop = data + (more[: ends[0]] + b" " if len(ends) else more), stop + len(more)
    return count, data


def _read_ascii(spark: SparkSession, path: str, header: dict[str, str], meta: Meta, range_bytes: int = TEXT_RANGE) -> Cube:
    """Numbers in text, which have no fixed width: words are counted by byte range, sums of the ranges before give each one its first sample, and ranges are parsed apart."""
    payload = _payload(path, header)
    system, name = _open(payload)
    size = system.get_file_info(name).size

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _open(payload)
        with files.open_input_file(at) as f:
            for batch in batches:
                starts = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_words_of(f, a, a + range_bytes, size)[0] for a in starts], pa.int64())], names=["start", "n"])

    parts = max(1, -(-size // range_bytes))
    ranges = spark.range(0, max(size, 1), range_bytes, min(parts, 1 << 16)).mapInArrow(counted, "start long, n long")
    counts = cut_lineage(ranges)  # a row for each range
    total, samples = counts.agg(F.sum("n")).first()[0] or 0, meta.leftsize(0)
    if total < samples:
        raise ValueError(f"{payload} holds fewer samples than its axes")
    before = F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select("start", F.coalesce(before, F.lit(0)).alias("first")).where(F.col("first") < samples)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = _open(payload)
        with files.open_input_file(at) as f:
            for batch in batches:
                for start, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    count, data = _words_of(f, start, start + range_bytes, size)
                    values = np.fromiter(map(float, data.split()), np.float64, count)
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), pa.array(values))], names=["first", "values"])

    spread = placed.repartition(min(parts, 1 << 16), "start").mapInArrow(parsed, "first long, values array<double>")
    words = spread.select("first", F.posexplode("values").alias("k", "v")).select((F.col("first") + F.col("k")).alias("at"), "v").where(F.col("at") < samples)
    keys, step = [], 1
    for k, a in enumerate(meta.axes, 1):
        keys.append((F.floor(F.col("at") / step) % a.n).cast("long").alias(f"i{k}"))
        step *= a.n
    return Cube(words.select(*keys, "v"), meta, "long")


def write(c: Cube | ComplexCube, path: str, kind: str = "", partitions: int | None = None) -> None:
    """Header at ``path`` and payload at ``path@``; absent traces are zeros.

    ``kind`` is a format, by default the native single one; ``ascii_float`` is
    text, of one trace a line.
    """
    if isinstance(c, ComplexCube):
        kind = kind or "native_complex"
        if kind not in COMPLEX:
            raise ValueError(f"data_format {kind} is not complex")
        pairs = F.flatten(F.zip_with("re", "im", lambda a, b: F.array(a, b))).alias("samples")
        flat = Cube(c.df.select(*c.keys, pairs), replace(c.meta, axes=(Axis(2 * c.meta.axes[0].n), *c.meta.axes[1:])), "trace")
        _write_payload(flat, path, COMPLEX[kind], partitions)
        _write_header(c.meta, path, kind, 2 * np.dtype(FORMATS[COMPLEX[kind]]).itemsize)
        return
    kind = kind or "native_float"
    if kind == "ascii_float":
        _write_ascii(c, path)
        return
    if kind not in FORMATS:
        raise ValueError(f"data_format {kind}")
    _write_payload(c, path, kind, partitions)
    _write_header(c.meta, path, kind, np.dtype(FORMATS[kind]).itemsize)


def _write_header(meta: Meta, path: str, kind: str, size: int) -> None:
    target, out = _open(path)
    with target.open_output_stream(out) as sink:
        sink.write(header_text(meta, kind, posixpath.basename(path) + "@", size).encode())


def _lines(c: Cube) -> DataFrame:
    """(at, line) of every trace, absent ones as zeros; the shortest text that gives each double back."""
    own = c.traces()
    n1, traces = own.meta.axes[0].n, own.meta.leftsize(1)
    zeros = " ".join(["0.0"] * n1) + "\n"
    text = F.concat(F.array_join(F.transform("samples", lambda v: v.cast("string")), " "), F.lit("\n"))
    given = own.df.select(_place(own.meta).alias("at"), text.alias("line"))
    every = own.df.sparkSession.range(traces).withColumnRenamed("id", "at")
    return every.join(given, "at", "left").select("at", F.coalesce("line", F.lit(zeros)).alias("line"))


def _write_ascii(c: Cube, path: str) -> None:
    """Text, which has no fixed width: traces are sorted by range, and sums of the bytes before give each range its place."""
    own = c.traces()
    lines = _lines(own)
    target, out = _open(path + "@")
    parts = int(c.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(lines.repartitionByRange(parts, "at").sortWithinPartitions("at").withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum(F.octet_length("line")).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("part", before.cast("long").alias("base"))  # a row for each partition
    if isinstance(target, fs.LocalFileSystem):
        size = sizes.agg(F.sum("bytes")).first()[0] or 0
        _at_places(ranged.join(F.broadcast(bases), "part").select("base", "line"), out, size)
    else:
        with target.open_output_stream(out) as sink:
            for row in ranged.orderBy("at").toLocalIterator():  # a store without positions: a partition at a time
                sink.write(row["line"].encode())
    _write_header(own.meta, path, "ascii_float", 0)


def _at_places(rows: DataFrame, out: str, size: int) -> None:
    """(base, line) rows: each partition's lines one after the other from its base; a task run again writes the same bytes, and the file is put in place whole."""
    temporary = f"{out}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.truncate(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        with open(temporary, "r+b") as f:  # fails where executors don't see the driver's files
            for batch in batches:
                for base, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if base != now:
                        now = at = base
                        f.seek(at)
                    f.write(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    rows.mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()
    os.replace(temporary, out)


def _place(meta: Meta):
    """Linear place of a trace."""
    at, step = F.lit(0).cast("long"), 1
    for k, a in enumerate(meta.axes[1:], 2):
        at, step = at + F.col(f"i{k}") * step, step * a.n
    return at


def _write_payload(c: Cube, path: str, kind: str, partitions: int | None) -> None:
    own = c.traces()
    n1, traces = own.meta.axes[0].n, own.meta.leftsize(1)
    target, out = _open(path + "@")
    if isinstance(target, fs.LocalFileSystem):
        _write_at(own, out, kind, n1, traces)
        return
    folder = f"{path}@parts-{uuid.uuid4().hex}"
    system, name = _open(folder)
    system.create_dir(name)
    at = _place(own.meta)
    parts = partitions or max(1, min(traces, traces * n1 * np.dtype(FORMATS[kind]).itemsize // (64 << 20) + 1))
    share = -(-traces // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each range of traces is one file of its own, replaced whole when a task is run again."""
        sink, expected, current, temporary = None, 0, None, ""
        files, root = _open(folder)

        def close() -> None:
            sink.write(np.zeros(max(0, min((current + 1) * share, traces) - expected) * n1, FORMATS[kind]).tobytes())
            sink.close()
            files.move(temporary, f"{root}/{current:08d}")

        for batch in batches:
            for part, place, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != current:
                    if sink:
                        close()
                    current, expected, temporary = part, part * share, f"{root}/.{uuid.uuid4().hex}"
                    sink = files.open_output_stream(temporary)
                sink.write(np.zeros((place - expected) * n1, FORMATS[kind]).tobytes())
                sink.write(np.asarray(samples.values, np.float64).astype(FORMATS[kind]).tobytes())
                expected = place + 1
        if sink:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    rows = own.df.select(F.floor(at / share).cast("long").alias("part"), at.alias("at"), "samples")
    rows.repartition(parts, "part").sortWithinPartitions("part", "at").mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()
    with target.open_output_stream(out) as sink:
        for part in range(-(-traces // share)):
            if system.get_file_info(f"{name}/{part:08d}").type == fs.FileType.NotFound:
                for _ in range(part * share, min((part + 1) * share, traces)):
                    sink.write(np.zeros(n1, FORMATS[kind]).tobytes())
                continue
            with system.open_input_stream(f"{name}/{part:08d}") as source:
                while block := source.read(BLOCK):
                    sink.write(block)
    system.delete_dir(name)


def _write_at(own: Cube, out: str, kind: str, n1: int, traces: int) -> None:
    """Every trace at its place in one file, whatever task holds it; a task run again writes the same bytes."""
    size, temporary = n1 * np.dtype(FORMATS[kind]).itemsize, f"{out}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.truncate(traces * size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(temporary, "r+b") as f:
            for batch in batches:
                values = np.asarray(batch.column(1).flatten(), np.float64).astype(FORMATS[kind]).reshape(batch.num_rows, -1)
                for place, row in zip(batch.column(0).to_pylist(), values, strict=True):
                    f.seek(place * size)
                    f.write(row.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([0])], names=["done"])

    own.df.select(_place(own.meta).alias("at"), "samples").mapInArrow(run, "done long").write.format("noop").mode("overwrite").save()
    os.replace(temporary, out)


def header_text(meta: Meta, kind: str, payload: str, size: int | None = None) -> str:
    quoted = lambda v: '"' + str(v).replace('"', "'") + '"'
    lines = [f"{k}={quoted(v)}" for k, v in meta.attrs.items() if k not in ("in", "esize", "data_format")]
    for k, a in enumerate(meta.axes, 1):
        lines.append(f"n{k}={a.n} o{k}={a.o!r} d{k}={a.d!r}")
        lines += [f"{word}{k}={quoted(v)}" for word, v in (("label", a.label), ("unit", a.unit)) if v]
    return "\n".join([*lines, f"esize={np.dtype(FORMATS[kind]).itemsize if size is None else size}", f'data_format="{kind}"', f'in="{payload}"', ""])


def put(path: str, **changes: object) -> None:
    """Header words added or replaced; the payload stays."""
    header = read_header(path) | {k: str(v) for k, v in changes.items()}
    system, name = _open(path)
    with system.open_output_stream(name) as sink:
        sink.write("".join(f'{k}="{v}"\n' for k, v in header.items()).encode())


def get(path: str, *keys: str) -> list[str | None]:
    header = read_header(path)
    return [header.get(k) for k in keys]


def info(path: str) -> dict[str, object]:
    """What a header says: format, shape, axes and other words."""
    header = read_header(path)
    meta = meta_of(header)
    return {"data_format": header.get("data_format", "native_float"), "shape": meta.shape, "samples": meta.leftsize(0), "axes": [(a.n, a.o, a.d, a.label, a.unit) for a in meta.axes], "words": meta.attrs}


def info_text(path: str) -> str:
    """The same as lines of text."""
    got = info(path)
    lines = [f"{path}:", f"    data_format={got['data_format']} samples={got['samples']}"]
    for k, (n, o, d, label, unit) in enumerate(got["axes"], 1):
        lines.append(f"    n{k}={n} o{k}={o:g} d{k}={d:g}" + (f' label{k}="{label}"' if label else "") + (f' unit{k}="{unit}"' if unit else ""))
    return "\n".join(lines)


def copy(path: str, to: str, overwrite: bool = False) -> tuple[str, str]:
    """Header and payload as they are, at another place; (header, payload) written."""
    header = read_header(path)
    payload = _payload(path, header)
    (source, at), (target, name), (sink, out) = _open(payload), _open(to), _open(to + "@")
    if at == out or _open(path)[1] == name:
        raise ValueError("input and output are the same file")
    for system, place in ((target, name), (sink, out)):
        if not overwrite and system.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{place} is there already")
    fs.copy_files(at, out, source_filesystem=source, destination_filesystem=sink)
    with target.open_output_stream(name) as stream:
        stream.write("".join(f'{k}="{v}"\n' for k, v in (header | {"in": posixpath.basename(to) + "@"}).items()).encode())
    return to, to + "@"


def remove(path: str, dry_run: bool = True, confirm: bool = False, missing_ok: bool = False) -> list[str]:
    """The files of a dataset; they are deleted only with ``confirm`` and without ``dry_run``."""
    system, name = _open(path)
    if system.get_file_info(name).type == fs.FileType.NotFound:
        if missing_ok:
            return []
        raise ValueError(f"{path} is not there")
    if system.get_file_info(name).type != fs.FileType.File:
        raise ValueError(f"{path} is not a file")
    payload = _payload(path, read_header(path))
    there = [p for p in (payload, path) if (lambda s, n: s.get_file_info(n).type == fs.FileType.File)(*_open(p))]
    if dry_run:
        return there
    if not confirm:
        raise ValueError("deletion needs confirm")
    for p in there:
        files, at = _open(p)
        files.delete_file(at)
    return there


def convert(spark: SparkSession, path: str, to: str, kind: str, truncate: bool = False) -> None:
    """The dataset in another format; integers are rounded half to even, or cut towards 0 with ``truncate``.

    A real dataset becomes complex with imaginary parts of 0; a complex one does not become real.
    """
    c = read(spark, path)
    if kind in COMPLEX and isinstance(c, Cube):
        from tracelake.operators.complexes import rtoc

        c = rtoc(c)
    elif kind.endswith("_int") and isinstance(c, Cube):
        c = c.map((lambda v: F.signum(v) * F.floor(F.abs(v))) if truncate else F.rint)
    write(c, to, kind)


def disfil(c: Cube | ComplexCube, limit: int = 1000, precision: int = 6, numbers: str = "flat") -> str:
    """Lines of the first ``limit`` samples in storage order, each with its number: flat, multi (slowest axis first), rsf (i1=..) or none."""
    if numbers not in ("flat", "multi", "rsf", "none"):
        raise ValueError("numbers are flat, multi, rsf or none")
    keys = [f"i{k}" for k in range(1, len(c.meta.axes) + 1)]
    df = c.long() if isinstance(c, ComplexCube) else c.long().df.select("*", F.col("v").alias("re"))
    at, step = F.lit(0).cast("long"), 1
    for k, a in zip(keys, c.meta.axes, strict=True):
        at, step = at + F.col(k) * step, step * a.n
    lines = []
    for row in df.withColumn("_at", at).where(F.col("_at") < limit).orderBy("_at").limit(limit).collect():
        text = f"{row['re']:.{precision}g}" + (f"{row['im']:+.{precision}g}j" if isinstance(c, ComplexCube) else "")
        label = {"flat": str(row["_at"]), "multi": "(" + ",".join(str(row[k]) for k in keys[::-1]) + ")", "rsf": ",".join(f"{k}={row[k]}" for k in keys), "none": ""}[numbers]
        lines.append(f"{label}\t{text}" if label else text)
    if step > limit:
        lines.append(f"# truncated: shown={limit} total={step} max={limit}")
    return "\n".join(lines)


def write_table(df: DataFrame, keys: list[str], path: str, row: str) -> None:
    """A header table: a row for each trace in order of ``row`` (0, 1, ..), a sample for each key, whose names the header keeps."""
    n = df.count()
    rows = df.select(F.col(row).cast("long").alias("i2"), F.array(*[F.col(k).cast("double") for k in keys]).alias("samples"))
    write(Cube(rows, Meta((Axis(len(keys)), Axis(max(1, n))), {f"key{k}": name for k, name in enumerate(keys)}), "trace"), path, "native_double")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(trace, one column for each key) of a header table."""
    c = read(spark, path)
    n = c.meta.axes[0].n
    return c.df.select(F.col("i2").alias("trace"), *[F.element_at("samples", k + 1).alias(str(c.meta.attrs.get(f"key{k}", f"key{k}"))) for k in range(n)])
