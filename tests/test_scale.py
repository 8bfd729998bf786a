"""What shows on larger tables only, on small ones that hold the same."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from jobs import watch_repositories
from stratalode.functions import constants as K
from stratalode.functions import languages as L
from stratalode.functions.text import stem, suffix
from stratalode.operators import candidates, extract, report, resolve


@pytest.fixture(scope="module")
def hub(spark, tmp_path_factory):
    """Documents of which more than 50 stand for files that import one module at the root."""
    folder = tmp_path_factory.mktemp("hub")
    spark.range(1, 75).select((F.col("id") * 51).alias("doc_id"), F.lit("some words").alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(10).cast("long").alias("n_chars")).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["scored_candidates", "job2_watch_repositories"])
def test_a_hub_that_is_passed_over_is_named_as_in_sql(spark, hub, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{hub}/documents.parquet/*.parquet')")
    df = __spark_entry__.queries()[name](spark, hub)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert rows == sorted(con.sql(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=repr)
    assert [r["suggested_name"] for r in df.filter("path = 'shared.py' AND skipped").collect()] == ["shared"]


def test_a_file_name_says_what_it_may_test(spark):
    names = ["a.py", "b", ".c", "d.e.js", "x.", "test_f.go", "Test", "_test.py", ".test"]
    forms = lambda s, e: [f"test_{s}{e}", *(f"{s}{end}{e}" for end in resolve.TEST_ENDS)]
    cut = spark.createDataFrame([(n,) for n in names], "n string").select("n", stem(F.col("n")).alias("s"), suffix(F.col("n")).alias("e")).collect()
    of = {(t, r["n"]) for r in cut for t in forms(r["s"], r["e"])}
    tests = spark.createDataFrame(sorted({(t,) for t, _ in of}), "t string").select("t", F.explode(resolve.tested_names(F.col("t"))).alias("n"))
    assert {tuple(r) for r in tests.collect() if r["n"] in names} == of


def test_a_file_travels_once_for_each_folder_above(spark):
    files = spark.createDataFrame([("r", f"a/b/m{i}.py") for i in range(40)] + [("r", "a/tests/test_m7.py")], "repo string, path string")
    found = resolve.tested(files)
    assert sorted(tuple(r) for r in found.collect()) == [("r", "a/b/m7.py"), ("r", "a/tests/test_m7.py")]
    # no row for each name that a test of a file may have
    assert "explode(array(concat(test_" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_licences_are_told_to_all_parts_of_a_repository(spark):
    rows = spark.range(4000).select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("repo"), F.col("id").cast("string").alias("path"))
    told = candidates.told_by_repo(rows.union(spark.createDataFrame([("none", "p")], rows.schema)), spark.createDataFrame([("r0", True), ("r1", False)], "repo string, has_license boolean"))
    assert {tuple(r) for r in told.groupBy("repo", "has_license").count().collect()} == {("r0", True, 2000), ("r1", False, 2000), ("none", None, 1)}
    assert "Join LeftOuter, ((repo" in (plan := told._jdf.queryExecution().optimizedPlan().toString()) and "_salt" in plan


def test_marks_are_told_to_all_parts_of_a_repository(spark):
    """The rows of a repository's candidates don't come together in one task, not even where nothing is broadcast."""
    text = F.col("id").cast("string")
    found = spark.range(4000).select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("repo"), text.alias("path"), F.repeat(text, 9).alias("first_lines"))
    due = spark.createDataFrame([("r0", 1, 7), ("r1", 2, 8), ("none", 3, 9)], "repo string, upto long, part int")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "40", "false"), strict=True):
            spark.conf.set(k, v)
        rows = watch_repositories.marked(due, found)
        assert rows.columns == ["repo", "upto", "part", "path", "first_lines"]
        told = {tuple(r) for r in rows.groupBy("repo", "upto", "part").agg(F.count("*"), F.count("path"), F.countDistinct("path"), F.count("first_lines")).collect()}
        assert told == {("r0", 1, 7, 2000, 2000, 2000, 2000), ("r1", 2, 8, 2000, 2000, 2000, 2000), ("none", 3, 9, 1, 0, 0, 0)}
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 500 and sum(sizes) == 4001
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_contents_of_packages_are_read_once(spark):
    files = spark.createDataFrame([("r", f"m{i}.py", f"x = {i}\n") for i in range(9)] + [("r", "LICENSE", "free"), ("s", "LICENSE", "not")], "repo string, path string, content string")
    picked = spark.createDataFrame([("r", "m1.py", ["m2.py", "gone.py"])], "repo string, path string, sibling_paths array<string>")
    assert sorted(r["path"] for r in extract.needed_files(picked, files).collect()) == ["LICENSE", "m1.py", "m2.py"]


def test_patterns_that_find_the_word_first_match_the_same(spark):
    texts = ["if (a)", "elif(x) if(", "aif (b) éif (c) if (d)", "if if(if (", "_if(x)\nif (y)", "unless x; end if", "", "whenif when", "forif for (", "1if (x) (if (y))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in sorted({p for r in L.RULES.values() for p in r.complexity}):
        row = df.select("t", F.regexp_count("t", F.lit(L.U + p)).alias("a"), F.regexp_count("t", F.lit(L.U + L._word_first(p))).alias("b"))
        assert row.filter("a <> b").collect() == []


def test_references_to_frameworks_are_looked_for_by_pieces(spark):
    texts = ["tf.logging.x", "tf_logging.", "a next/router", "models.Model", "modelsXModel", "django.db.models", "nothing", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", candidates.project_refs(F.col("t")).alias("a"), F.col("t").rlike("|".join(K.PROJECT_REFS)).alias("b"))
    assert df.filter("a <> b").collect() == [] and df.filter("a").count() == 4
    assert "RLIKE" not in df.drop("b")._jdf.queryExecution().optimizedPlan().toString()


def test_ranks_of_reports_are_given_to_narrow_rows(spark):
    plain = {"combined_score": F.lit(5.0), "loc": F.lit(20), "language": F.lit("Go"), "skipped": F.col("id") % 4 == 3, "skip_reason": F.when(F.col("id") % 4 == 3, "no").otherwise("")}
    numbers = ("complexity", "fan_in", "internal_imports", "external_imports", "dependency_weight", "api_surface_count")
    more = {c: F.lit(0) for c in numbers} | {c: F.lit(1.0) for c in ("code_quality", "usefulness", "uniqueness", "relevance", "maintainability", "demand_signal", "ship_effort_hours", "comment_ratio")}
    more |= {c: F.lit(False) for c in ("has_tests", "has_docstring", "source_has_license", "in_cycle", "is_stdlib_only", "has_project_specific_refs")}
    more |= {c: F.array().cast("array<string>") for c in ("sibling_paths", "why_extractable", "suggested_tags")}
    more |= {"extraction_type": F.lit("single"), "what_it_does": F.lit(""), "docstring_snippet": F.lit(""), "first_lines": F.lit("package a"), "suggested_name": F.lit("n")}
    rows = spark.range(8).withColumns({"repo": F.lit("r"), "path": F.concat(F.lit("f"), F.col("id").cast("string"))} | plain | more)
    pages = report.reports(rows, spark.createDataFrame([("r", "Go"), ("s", "Go")], "repo string, language string"), "now", most=2)
    got = {r["repo"]: r["report"] for r in pages.collect()}
    assert [x.split(" —")[0] for x in got["r"].splitlines() if x.startswith(("### ", "- `"))] == ["### 1. `f0`", "### 2. `f1`", "- `f2`", "- `f4`", "- `f5`", "- `f6`", "- `f3`", "- `f7`"]
    assert "Nothing here" in got["s"]
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert all("first_lines" not in x for x in plan.splitlines() if "Window [" in x) and plan.count("Window [") >= 2
