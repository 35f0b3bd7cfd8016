import os

from tracelake.streaming.binning import windowed_bins


def test_stream_agrees_with_table(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    os.makedirs(tmp_path / "in")
    os.symlink(source, tmp_path / "in/events.parquet")
    schema = spark.read.parquet(source).schema
    stream = windowed_bins(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 hour", "10 minutes")
    run = stream.writeStream.format("memory").queryName("bins").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    want = windowed_bins(spark.read.parquet(source), "1 hour", "10 minutes")
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("bins").collect())) == sorted(map(key, want.collect()))
