"""The jobs: whole results, runs again and over growing input, the command lines."""

from __future__ import annotations

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import portfolio_report, watch_repositories
from jobs import queries as jobs
from stratalode.operators import candidates, scan
from stratalode.plans.corpus import as_files

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
CONFIG = {"max_candidates": 3, "min_score": 4.0, "generated": "then"}
WATCH = {"parts": 4, "files_per_batch": 1}
BODY = "".join(f"    x{i} = {i}\n" for i in range(15))
SHAPE = "repo string, path string, content string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def added(spark, folder, table):
    """One more file of rows."""
    spark.createDataFrame(table, SHAPE).coalesce(1).write.mode("append").parquet(folder)


def test_portfolio_of_small_repositories(spark, tmp_path):
    table = [("a/one", f"src/m{i}.py", f'"""Module {i}."""\ndef parse_{i}(x):\n{BODY}') for i in range(6)] + [("a/one", "LICENSE", "MIT"), ("b/two", "lib/x.js", "export function slugify(a) {\n" + "  let b = 1;\n" * 15 + "}\n"), ("c/none", "README.md", "nothing")]
    added(spark, f"{tmp_path}/in", table)
    told = portfolio_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG)
    assert told == {"read": 9, "errors": 0, "ranking": 7, "summary": 2, "reports": 3}
    ranking = spark.read.parquet(f"{tmp_path}/out/ranking")
    assert [r["rank"] for r in ranking.filter("repo = 'a/one'").orderBy("rank").collect()] == [*range(1, 7)]
    pages = {r["repo"]: r["report"] for r in spark.read.parquet(f"{tmp_path}/out/reports").collect()}
    assert pages["a/one"].count("\n**Location:** ") == 3 and pages["a/one"].count("- `src/m") == 3 and "**What it does:** Module 0." in pages["a/one"]
    assert pages["b/two"].count("### ") == 1 and "Nothing here can be lifted out" in pages["c/none"]
    once = {t: rows(spark.read.parquet(f"{tmp_path}/out/{t}")) for t in ("ranking", "summary", "reports")}
    assert portfolio_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", CONFIG) == told
    assert once == {t: rows(spark.read.parquet(f"{tmp_path}/out/{t}")) for t in once}


def test_portfolio_without_candidates(spark, tmp_path):
    """An empty table, and one that had candidates before and has none now."""
    code = f"def slugify(a):\n{BODY}"
    for name, table, ranked in (("one", [("a/x", "p/s.py", code)], 1), ("none", [("a/x", "README", "n")], 0), ("empty", [], 0)):
        added(spark, f"{tmp_path}/{name}", table)
        told = portfolio_report.run(spark, f"{tmp_path}/{name}", f"{tmp_path}/out", CONFIG)
        assert (told["read"], told["ranking"], told["summary"], told["reports"]) == (len(table), ranked, ranked, min(len(table), 1))


def detected(files):
    kept = candidates.detect(scan.scan_filter(files), scan.licenses(files))
    return rows(kept.select("repo", "path", "skipped", "skip_reason", "fan_in", "in_cycle", "has_tests", "loc", F.to_json("why_extractable")))


def held(spark, out):
    return rows(spark.read.parquet(f"{out}/candidates").filter("path IS NOT NULL").select("repo", "path", "skipped", "skip_reason", "fan_in", "in_cycle", "has_tests", "loc", F.to_json("why_extractable")))


def test_watching_takes_only_what_is_new(spark, tmp_path):
    """Documents arrive in two files; after each run the candidates are those of all that has come."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    run = lambda: watch_repositories.run(spark, folder, out, f"{tmp_path}/state", WATCH)
    for low, high in [(0, 199), (199, 1 << 30)]:
        documents.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).coalesce(1).write.mode("append").parquet(folder)
        told = run()
        assert told["read"] == documents.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)).count()
        assert told["judged"] == (1 if low else 3)  # the last document changes one repository
        assert held(spark, out) == detected(as_files(spark.read.parquet(folder)))
    facts = spark.read.parquet(f"{out}/facts")
    assert facts.groupBy("digest", "ext").count().filter("count > 1").count() == 0
    assert {r["batch"]: r["count"] for r in facts.groupBy("batch").count().collect()}[1] >= 1
    before = held(spark, out)
    assert run() == {"read": 0, "judged": 0, "candidates": 0} and held(spark, out) == before


def test_new_versions_and_untouched_repositories(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: watch_repositories.run(spark, folder, out, f"{tmp_path}/state", WATCH)
    code = lambda name: f"def {name}(a):\n{BODY}"
    first = [("a/x", "p/one.py", f"from .two import t\n{code('one')}"), ("a/x", "p/three.py", code("three")), ("b/y", "q/z.py", code("z")), ("b/y", "zz_generated.py", code("g"))]
    added(spark, folder, first)
    run()
    assert {r["path"]: r["skip_reason"] for r in spark.read.parquet(f"{out}/candidates").collect()} == {"p/one.py": "References missing sibling(s): two", "p/three.py": "", "q/z.py": ""}
    # the sibling arrives, a file changes, another is sent again as it was
    second = [("a/x", "p/two.py", code("two")), ("a/x", "p/three.py", f"import p\n{code('other')}"), ("b/y", "q/z.py", code("z")), ("a/x", "p/copy.py", code("z"))]
    added(spark, folder, second)
    told = run()
    assert (told["read"], told["judged"]) == (4, 1)
    latest = {(r, p): c for r, p, c in first + second}
    whole = spark.createDataFrame([(r, p, c) for (r, p), c in latest.items()], SHAPE)
    assert held(spark, out) == detected(portfolio_report.files_of(whole))
    assert spark.read.parquet(f"{out}/facts").filter("batch = 1").count() == 2  # the copy's content is known
    assert {r["repo"]: r["upto"] for r in spark.read.parquet(f"{out}/candidates").collect()} == {"a/x": 1, "b/y": 0}
    # nothing is left of a repository's candidates
    added(spark, folder, [("b/y", "q/z.py", "z = 1")])
    assert (run()["judged"], spark.read.parquet(f"{out}/candidates").filter("repo = 'b/y' AND path IS NOT NULL").count()) == (1, 0)
    assert run()["judged"] == 0


def test_a_content_that_only_a_test_had_is_looked_at_again(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    run = lambda: watch_repositories.run(spark, folder, out, f"{tmp_path}/state", WATCH)
    same = f"def helper(a):\n{BODY}"
    added(spark, folder, [("a/x", "tests/test_helper.py", same)])
    run()
    added(spark, folder, [("a/x", "src/helper.py", same)])
    run()
    assert [(r["path"], r["has_tests"]) for r in spark.read.parquet(f"{out}/candidates").collect()] == [("src/helper.py", True)]
    added(spark, folder, [("a/x", "tests/test_other.py", same)])
    assert run()["judged"] == 1 and spark.read.parquet(f"{out}/facts").count() == 2


def test_a_batch_that_is_taken_twice(spark, tmp_path):
    """As after a failure between the tables and the checkpoint."""
    batch = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = []
    for _ in range(2):
        watch_repositories.take(batch, 0, f"{tmp_path}/out", 4)
        seen.append({t: rows(spark.read.parquet(f"{tmp_path}/out/{t}")) for t in ("files", "facts")})
    assert seen[0] == seen[1] and seen[0]["facts"]
    assert watch_repositories.judge(spark, f"{tmp_path}/out")[0] == 3
    assert held(spark, f"{tmp_path}/out") == detected(as_files(batch))


@pytest.mark.parametrize("name", sorted(jobs.QUERIES))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    df = jobs.QUERIES[name](spark, DATA)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    assert rows(df) == sorted(con.sql(f"SELECT {columns} FROM ({jobs.SQL[name]})").fetchall(), key=repr)


def test_command_lines(spark, tmp_path):
    added(spark, f"{tmp_path}/in", [("a/x", "p/one.py", f"def one(a):\n{BODY}")])
    config = tmp_path / "config.json"
    config.write_text(json.dumps(CONFIG | WATCH))
    env = os.environ | {"PYTHONPATH": str(ROOT)}
    for call, told in ((["jobs.portfolio_report", f"{tmp_path}/in", f"{tmp_path}/a"], "ranking: 1 rows"), (["jobs.watch_repositories", f"{tmp_path}/in", f"{tmp_path}/b", f"{tmp_path}/state"], "1 repositories judged, 1 candidates written")):
        done = subprocess.run([sys.executable, "-m", *call, "--config", str(config), "--master", "local[2]"], env=env, cwd=ROOT, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and told in done.stderr, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/a/ranking").count() == spark.read.parquet(f"{tmp_path}/b/candidates").count() == 1
