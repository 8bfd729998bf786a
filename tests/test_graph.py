"""The import graph: fan-in and components against brute force, long chains, packages that everybody imports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratalode.operators import graph
from stratalode.sources.files import from_table

EDGES = "repo string, src string, dst string"


def brute_components(edges):
    out = set()
    for repo in {r for r, _, _ in edges}:
        after = {}
        for r, a, b in edges:
            if r == repo:
                after.setdefault(a, set()).add(b)
                after.setdefault(b, set())
        reach = {}
        for a in after:
            seen, todo = set(), [a]
            while todo:
                new = after[todo.pop()] - seen
                seen |= new
                todo += new
            reach[a] = seen
        for a in after:
            group = [b for b in after if b != a and b in reach[a] and a in reach[b]]
            if group:
                out.add((repo, a, min([a, *group])))
    return out


@pytest.mark.parametrize("most,seed", [(1 << 20, 0), (25, 1), (1, 2)])
def test_components_of_random_graphs(spark, most, seed):
    rng = random.Random(seed)
    edges = [(f"r{r}", f"{rng.randrange(n):03}", f"{rng.randrange(n):03}") for r, n, m in ((0, 40, 60), (1, 90, 110), (2, 5, 30), (3, 60, 59)) for _ in range(m)]
    edges += [("chain", f"{i:03}", f"{i + 1:03}") for i in range(40)]  # no circle at all
    found = graph.strong_components(spark.createDataFrame(edges, EDGES), most)
    assert {tuple(r) for r in found.collect()} == brute_components(edges)


def test_no_edges(spark):
    assert graph.strong_components(spark.createDataFrame([], EDGES)).count() == 0
    assert graph.strong_components(spark.createDataFrame([("r", "a", "a")], EDGES), 1).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_a_long_chain_that_closes(spark, most, monkeypatch):
    n, written = 10_000, []
    whole = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or whole(df))
    chain = spark.range(n).select(F.lit("r").alias("repo"), F.format_string("%05d", "id").alias("src"), F.format_string("%05d", (F.col("id") + 1) % n).alias("dst"))
    found = graph.strong_components(chain, most)
    assert found.count() == n and [tuple(r) for r in found.select("component").distinct().collect()] == [("00000",)]
    assert len(written) < 30


def brute_fan_in(edges, paths):
    return {p: len({a for _, a, b in edges if b == p}) for p in paths}


def test_fan_in_of_random_packages(spark):
    rng = random.Random(3)
    paths = [f"{rng.choice(['a', 'b', 'a/c', 'b/a', ''])}/{n}.py".lstrip("/") for n in "a b c d e __init__ x y z".split() for _ in range(4)]
    paths = sorted(set(paths))
    said = ["import a", "import b", "import c.d", "from a import x", "from .a import q", "from .x import q", "from . import y", "from .b import c", "import x", "import __init__", "from z import a"]
    rows = [("r", p, "\n".join(rng.choices(said, k=rng.randrange(6)))) for p in paths]
    table = from_table(spark.createDataFrame(rows, "repo string, path string, content string"))
    parts = graph.import_graph(table)
    edges = [tuple(r) for r in graph.import_edges(parts).collect()]
    assert len(edges) > 60
    assert {r["path"]: r["fan_in"] for r in graph.fan_in(table, parts).collect()} == brute_fan_in(edges, paths)
    assert {tuple(r) for r in graph.import_cycles(parts).collect()} == brute_components(edges)
    assert {tuple(r) for r in graph.import_cycles(parts, 1).collect()} == brute_components(edges)


def test_a_package_that_all_import_is_not_multiplied_out(spark, monkeypatch):
    n, rows = 5_000, []
    whole = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rows.append((t := whole(df)).count()) or t)
    files = spark.range(2 * n).select(
        F.lit("r").alias("repo"), F.when(F.col("id") < n, F.format_string("pkg/m%d.py", "id")).otherwise(F.format_string("app/u%d.py", "id")).alias("path"),
        F.when(F.col("id") < n, F.lit("x = 1")).otherwise(F.format_string("import pkg\nimport m%d\n", F.col("id") % 100)).alias("content"),
    )
    table = from_table(files)
    parts = graph.import_graph(table)
    got = {r["fan_in"]: r["count"] for r in graph.fan_in(table, parts).groupBy("fan_in").count().collect()}
    assert got == {n: n, 0: n}
    assert graph.import_cycles(parts).count() == 0
    assert sum(rows) < 12 * n
