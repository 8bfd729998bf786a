"""A uniform shuffle of rows into shards of exact size, by a communication matrix.

Every input partition is permuted where it lies: a sort inside the partition by random
numbers, in which a row's place is counted. How many rows each partition sends to each
shard is drawn beforehand, as a uniform shuffle of all rows would have it: the matrix of
these counts has the partitions' sizes as sums of its rows, the shards' sizes as sums of
its columns, and its entries are hypergeometric. It is drawn along a binary tree over the
partitions: each node splits what its shards get between its halves, shard after shard,
by inversion of the distribution from its recursion; a node is one row, so a level of the
tree is one narrow step over rows. A partition's first rows go to the first shard, and so
on. After the exchange each shard is permuted again: random numbers deal its rows into
buckets of about ``BUCKET_ROWS``, a row's slot is its rank in the bucket after the rows
of all buckets before. Rows meet in tasks by (partition) and (shard, bucket) only, which
are even whatever the rows hold; no content is a key.

Only built-in functions run. What one task holds at most is the list of partition sizes
and, at the top of the tree, some hundred numbers a shard.

Edge cases: nulls, empty and long texts and repeated rows are rows like any other, and
each has its own place; the first ``rows mod shards`` shards have one row more than the
others; an empty table gives no rows; fewer rows than shards leave the last shards empty.
Columns named ``shard`` or ``slot`` are replaced, other names can't clash. The same seed
over the same input partitions gives the same shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalode.llm._shared import dropped, written

SHARDS = 16
#: Rows of one shard that are sorted together in the second permutation, on average.
BUCKET_ROWS = 1024
#: A level of the tree with this many nodes is dealt over the tasks.
DEALT_AT = 256


def uniform(*seeds: Column) -> Column:
    """A number from 0 to below 1 that depends on ``seeds``."""
    return F.shiftrightunsigned(F.xxhash64(*seeds), 11) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, taken: Column, u: Column) -> Column:
    """How many of ``taken`` rows drawn from ``total`` are among its ``marked`` ones, at the quantile ``u``.

    The values within ten deviations (and twenty more) of the mean are weighed by their ratios, from
    the lowest up; those outside have less than 2^-60 of the whole."""
    real = lambda c: c.cast("double")
    part = real(marked) / F.greatest(total, F.lit(1))
    spread = F.ceil(10 * F.sqrt(taken * part * (1 - part) * (total - taken) / F.greatest(total - 1, F.lit(1)))) + 20
    mean = F.floor(taken * part)
    low = F.greatest(F.lit(0), taken + marked - total, mean - spread).cast("long")
    high = F.least(taken, marked, mean + spread).cast("long")
    ratio = lambda k: real(marked - k) * real(taken - k) / (real(k + 1) * real(total - marked - taken + k + 1))
    steps = F.sequence(low, high - 1)

    def summed(a: Column, k: Column) -> Column:
        w = a["w"] * ratio(k)
        return F.struct(w.alias("w"), (a["s"] + w).alias("s"))

    def counted(a: Column, k: Column) -> Column:
        w = a["w"] * ratio(k)
        return F.struct(w.alias("w"), (a["s"] + w).alias("s"), a["goal"].alias("goal"), (a["n"] + (a["s"] <= a["goal"]).cast("long")).alias("n"))

    one = F.lit(1.0)
    whole = F.aggregate(steps, F.struct(one.alias("w"), one.alias("s")), summed)["s"]
    begun = F.struct(one.alias("w"), one.alias("s"), (whole * u).alias("goal"), low.alias("n"))
    return F.when(high > low, F.aggregate(steps, begun, counted)["n"]).otherwise(low)


def _half(room: Column, taken: Column, seeds: list[Column]) -> Column:
    """Of shards with ``room`` rows each, how many fall to ``taken`` of all those rows: one shard after the other."""

    def step(a: Column, x: Column) -> Column:
        n = hypergeometric(a["total"], x["n"], a["taken"], uniform(*seeds, x["i"]))
        return F.struct((a["total"] - x["n"]).alias("total"), (a["taken"] - n).alias("taken"), F.concat(a["out"], F.array(n)).alias("out"))

    numbered = F.transform(room, lambda n, i: F.struct(n.alias("n"), i.alias("i")))
    total = F.aggregate(room, F.lit(0).cast("long"), lambda a, n: a + n)
    none = F.array().cast("array<bigint>")
    return F.aggregate(numbered, F.struct(total.alias("total"), taken.alias("taken"), none.alias("out")), step)["out"]


def communication_matrix(sizes: DataFrame, partitions: int, rows: int, shards: int, seed: int) -> DataFrame:
    """sizes (part, n), part from 0 below ``partitions`` -> (part, sent: rows to each shard)."""
    spark = sizes.sparkSession
    levels = max(0, (partitions - 1).bit_length())
    each = spark.range(1 << levels).withColumnRenamed("id", "part").join(sizes, "part", "left").select(F.struct("part", F.coalesce("n", F.lit(0)).cast("long").alias("n")).alias("x"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.lit(rows // shards).cast("long") + (i < rows % shards).cast("long"))
    tree = each.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["n"]).alias("sizes")).select(F.lit(0).cast("long").alias("part"), room.alias("sent"), "sizes")
    for level in range(levels):
        if 1 << level == DEALT_AT:
            tree = tree.repartition("part")
        half = 1 << levels - level - 1
        first = F.slice("sizes", 1, half)
        split = tree.withColumn("first", _half(F.col("sent"), F.aggregate(first, F.lit(0).cast("long"), lambda a, n: a + n), [F.lit(seed), F.lit(level), F.col("part")]))
        left = F.struct((F.col("part") * 2).alias("part"), F.col("first").alias("sent"), first.alias("sizes"))
        right = F.struct((F.col("part") * 2 + 1).alias("part"), F.zip_with("sent", "first", lambda a, b: a - b).alias("sent"), F.slice("sizes", half + 1, half).alias("sizes"))
        tree = split.select(F.explode(F.array(left, right)).alias("x")).select("x.*")
    return tree.select("part", "sent")


def shuffle_into_shards(df: DataFrame, shards: int = SHARDS, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with shard (int, from 0) and slot (long, without gaps from 0 in each shard). All columns travel
    with their rows: give it what is needed there."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    rows = df.select((F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.lit(0)).alias("row"), F.rand(seed).alias("u"))
    at = F.monotonically_increasing_id()
    local = rows.sortWithinPartitions("u").select("row", at.alias("at"))
    held = written(local.select("row", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "permuted", narrow=True)
    n, partitions = held.agg(F.count("*"), F.coalesce(F.max("part"), F.lit(-1)) + 1).first()
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, partitions, n, shards, seed)
    bounds = F.aggregate("sent", F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))
    bits = max(0, (n // (shards * bucket_rows)).bit_length())
    v = F.xxhash64(F.lit(seed), F.lit("slot"), "part", "place")
    placed = held.join(matrix.select("part", bounds.alias("bounds")), "part").select(
        "row", F.size(F.filter("bounds", lambda b: b <= F.col("place"))).alias("shard"), v.alias("v"), "part", "place"
    ).withColumn("bucket", F.shiftrightunsigned("v", 64 - bits) if bits else F.lit(0).cast("long"))
    sent = written(placed, "sent", narrow=True)
    dropped(held)
    counts = sent.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(W.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = sent.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("v", "part", "place")))
    return ranked.join(before, ["shard", "bucket"]).select(*(["row.*"] if names else []), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Whole rows at ``path``, a folder for each shard, its files and their rows in order of slot."""
    placed = shuffle_into_shards(df, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
