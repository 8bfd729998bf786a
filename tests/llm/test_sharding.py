"""Shards: exact sizes, whole rows, slots without gaps, and the distributions of the draws."""

from __future__ import annotations

import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import queries, sharding


def placed(df, **how):
    return [tuple(r) for r in sharding.shuffle_into_shards(df, **how).collect()]


def assert_exact(rows, shards):
    sizes = Counter(r[-2] for r in rows)
    assert [sizes[s] for s in range(shards)] == [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    for s in sizes:
        assert sorted(r[-1] for r in rows if r[-2] == s) == [*range(sizes[s])]


@pytest.mark.parametrize("n,partitions,shards,bucket", [(0, 1, 4, 10), (1, 1, 16, 10), (5, 7, 16, 10), (1003, 5, 7, 8), (4000, 33, 16, 16), (300, 3, 1, 1024)])
def test_sizes_are_exact_and_no_row_is_lost(spark, n, partitions, shards, bucket):
    rows = placed(spark.range(0, n, 1, partitions), shards=shards, bucket_rows=bucket)
    assert_exact(rows, shards)
    assert sorted(r[0] for r in rows) == [*range(n)]


def test_odd_rows_and_clashing_names(spark):
    rows = [(None, None, "x"), (None, None, "x"), (3, "", "x"), (3, "y" * 100_000, "x"), (4, "ü", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumn("part", F.lit(1)).withColumn("v.w", F.lit(2)).withColumn("row", F.lit(3)).withColumn("rank", F.lit(9)).repartition(4)
    found = sharding.shuffle_into_shards(df, shards=4)
    assert found.columns == ["doc_id", "text", "part", "v.w", "row", "rank", "shard", "slot"]
    got = [tuple(r) for r in found.collect()]
    assert_exact(got, 4)
    assert Counter(r[:6] for r in got) == Counter((a, b, 1, 2, 3, 9) for a, b, _ in rows)


def test_a_seed_gives_one_shuffle(spark):
    df = spark.range(0, 500, 1, 6)
    assert sorted(placed(df, seed=5)) == sorted(placed(df, seed=5)) != sorted(placed(df, seed=6))


@pytest.mark.parametrize("total,marked,taken", [(50, 12, 20), (10, 10, 4), (9, 0, 5), (7, 3, 7), (100_000, 6_250, 50_000), (1_000_000, 20, 300_000)])
def test_draws_follow_the_distribution(spark, total, marked, taken):
    n = 20_000
    drawn = spark.range(n).select(sharding.hypergeometric(F.lit(total), F.lit(marked), F.lit(taken), sharding.uniform(F.lit(7), "id")).alias("k"))
    found = {r["k"]: r["count"] for r in drawn.groupBy("k").count().collect()}
    assert sum(found.values()) == n and min(found) >= max(0, taken + marked - total) and max(found) <= min(marked, taken)
    if total <= 50:
        expected = {k: n * comb(marked, k) * comb(total - marked, taken - k) / comb(total, taken) for k in range(min(marked, taken) + 1)}
        chi = sum((found.get(k, 0) - e) ** 2 / e for k, e in expected.items() if e >= 5)
        assert chi < 40  # at most 13 values
    else:
        p, values = marked / total, np.repeat([*found], [*found.values()])
        variance = taken * p * (1 - p) * (total - taken) / (total - 1)
        assert abs(values.mean() - taken * p) < 5 * (variance / n) ** 0.5 and 0.93 < values.var() / variance < 1.07


def test_matrix_keeps_both_sums(spark):
    sizes = [5, 0, 130, 17, 1, 64, 33]
    table = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "part long, n long")
    rows = {r["part"]: r["sent"] for r in sharding.communication_matrix(table, len(sizes), sum(sizes), 6, 1).collect()}
    assert [sum(rows[i]) for i in range(len(rows))] == [*sizes, 0]
    assert [sum(c) for c in zip(*rows.values(), strict=True)] == [sum(sizes) // 6 + (s < sum(sizes) % 6) for s in range(6)]


def test_places_of_rows_are_uniform(spark):
    """Over many shuffles, a sorted input's rows reach every shard and slot alike."""
    hits = np.zeros((6, 6))
    for seed in range(6):
        for row, shard, _ in placed(spark.range(0, 360, 1, 3), shards=6, seed=seed):
            hits[row // 60, shard] += 1
    expected = hits.sum() / 36
    assert ((hits - expected) ** 2 / expected).sum() < 60  # 25 degrees of freedom, fixed seeds


def test_written_shards_come_back_in_order(spark, tmp_path):
    sharding.write_shards(spark.range(0, 200, 1, 4).withColumn("text", F.col("id").cast("string")), f"{tmp_path}/out", shards=3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.filter("text = id").count() == 200
    for s in range(3):
        assert [r["slot"] for r in back.filter(F.col("shard") == s).orderBy(F.input_file_name(), F.monotonically_increasing_id()).select("slot").collect()] == [*range(67 if s < 2 else 66)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    found = queries.op11_sharding(spark, sf)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert_exact([(r["doc_id"], r["shard"], r["slot"]) for r in rows], 16)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
