"""What several operators use: tables in the shared folder, salted joins, batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step takes at most, unless one text alone is longer.
STEP_BYTES = 1 << 19


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir; without
    that setting, as in tests, in a temporary folder that is then set there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='stratalode-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a job as soon as it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here, a lost executor
    costs no more than the tasks that read it, and the shuffle files behind it go at once.
    ``narrow`` tables of a few numbers a row come in a file for six shuffle partitions, but no fewer
    than four for each core."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(max(32, 4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 6))
    path = shared_path(spark, name)
    shape = df.schema
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(shape).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once all that is made from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on Spark hands texts to Python in Arrow batches of at most ``most`` bytes;
    its own bound, over ten times that, costs several copies in each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def trim() -> None:
    """Gives freed memory back to the system; Python workers stay alive between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which its task leaves no spare memory in the worker."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def salt(key: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, salts: int = 16) -> DataFrame:
    """left LEFT JOIN right on ``keys``, where few keys may hold most of the left rows:
    those are dealt over ``salts`` tasks by ``spread``, a column of left. The right
    side is repeated ``salts`` times; it should hold each key once."""
    dealt = left.withColumn("_salt", salt(F.col(spread), salts))
    copies = right.withColumn("_salt", F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    return dealt.join(copies, [*keys, "_salt"], "left").drop("_salt")


def steps(batch: pa.RecordBatch, text: int = 1, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes in column ``text``, one row at least."""
    column = batch.column(text)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
