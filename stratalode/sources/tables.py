"""Parquet tables as they come from a folder, and intermediate ones in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, a temporary one that is then set there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='stratalode-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    for paths in _open[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that ``cut_lineage`` has written meanwhile."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stream_of(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    """The Parquet files at ``path`` as a stream, those that come later too. ``path`` may be a single file, which
    streams take only as what a pattern finds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    single = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]" if single else path)


def table_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table at ``path``, or none of its rows where nothing has been written yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def replaced(df: DataFrame, path: str, by: str, whole: bool = False) -> DataFrame:
    """Writes ``df`` to the table at ``path`` in place of the partitions that it has rows of, or of the ``whole`` table;
    the table as it then stands."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy(by).parquet(path)
    return table_or_empty(df.sparkSession, path, df.schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``. One that is a single file no longer than a split is one task's work, whatever
    is done with its rows; those few are dealt out over the cores."""
    table = spark.read.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = status.isFile() and status.getLen() <= split
    return table.repartition(spark.sparkContext.defaultParallelism) if small else table
