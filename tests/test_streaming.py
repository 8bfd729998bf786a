"""Signals of a stream equal those of a table."""

from __future__ import annotations

from stratalode.streaming.signals import arriving, signals


def test_stream_equals_table(spark, tmp_path):
    rows = [("r", f"p/m{i}.py", ".py", "import os\n" + "x = 1\n" * i) for i in range(8)] + [("r", "vendor/a.py", ".py", "x"), ("r", "tests/a.py", ".py", "x")]
    shape = "repo string, path string, ext string, content string"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    arriving(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    expected = signals(spark.read.parquet(f"{tmp_path}/in")).collect()
    assert len(expected) == 8 and sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=repr) == sorted(map(tuple, expected), key=repr)
