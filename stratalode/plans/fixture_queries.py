"""Queries over the repositories and texts of ``fixture`` that documents stand for: rules that no text reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalode.functions import languages as L
from stratalode.functions.text import lines, strip
from stratalode.operators import candidates, describe, extract, graph, naming, report, scan, scoring, search
from stratalode.plans import fixture
from stratalode.plans.fixture import code_fixture

ASOF = "2025-06-30"


def _joined(c: Column) -> Column:
    return F.array_join(c, ",")


def fixture_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that a scan keeps; byte-order marks don't count in the lines."""
    return scan.scan_filter(code_fixture(spark, sf_dir)).filter("repo LIKE 'fix/gates-%'").select("repo", "path", F.length("content").cast("long").alias("n_chars"), F.col("loc").cast("long").alias("loc"))


def fixture_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that may hold candidates, and what their names tell."""
    path = F.col("path")
    return code_fixture(spark, sf_dir).filter("repo NOT LIKE 'fix/graph-%'").select(
        "repo", "path", L.language(F.col("ext")).alias("language"), F.coalesce(scan.hard_gate(path, F.col("ext")), F.lit(False)).alias("passes"),
        scan.framework_route(path).alias("is_route"), scan.filename_score(path).alias("score"),
    )


def fixture_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, imports, declarations, branches and documentation of one file for each language."""
    files = code_fixture(spark, sf_dir).filter("repo LIKE 'fix/langs-%'").withColumns({"fam": L.family(F.col("ext")), "lines": lines(F.col("content"))}).filter("fam IS NOT NULL")
    fam, content, ls = F.col("fam"), F.col("content"), F.col("lines")
    files = files.withColumn("stripped", F.transform("lines", strip)).withColumns({"p": L.parsed(fam, content), "imports": L.external_imports(fam, ls)})
    python = fam == "python"
    relative = F.when(python, F.col("p.relative")).otherwise(L.relative_imports(fam, content))
    weight = L.dependency_weight(fam, F.col("imports"))
    return files.select(
        "path", L.logical_loc(fam, F.col("stripped")).cast("long").alias("loc"), F.round(L.comment_ratio(fam, F.col("stripped")), 6).alias("comments"), _joined(F.col("imports")).alias("imports"),
        _joined(F.transform(relative, lambda r: F.concat(r["name"], F.lit(":"), r["level"].cast("string")))).alias("relative"),
        _joined(F.when(python, F.col("p.names")).otherwise(L.public_api(fam, content))).alias("names"), F.when(python, F.col("p.complexity")).otherwise(L.complexity(fam, content)).cast("long").alias("complexity"),
        F.when(fam == "go", F.col("p.doc")).otherwise(L.docstring(fam, ls, F.col("stripped"))).alias("doc"), L.internal_lines(fam, ls).cast("long").alias("own_lines"),
        weight["weight"].cast("long").alias("weight"), weight["stdlib_only"].alias("stdlib_only"),
    )


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.detect(code_fixture(spark, sf_dir))  # unfiltered, so that gates behind the scan's are reached too


def fixture_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates in their order, and what holds for the files that pass them."""
    return _detected(spark, sf_dir).filter("NOT path LIKE 'use%' OR path = 'use7.py'").select(
        "repo", "path", "language", F.col("loc").cast("long").alias("loc"), "skipped", "skip_reason", "extraction_type", _joined(F.col("sibling_paths")).alias("siblings"), _joined(F.col("missing_siblings")).alias("missing"),
        F.col("internal_imports").cast("long").alias("internal"), F.col("fan_in").cast("long").alias("fan_in"), "in_cycle", "has_tests", "has_docstring", "source_has_license",
    )


def fixture_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates can be lifted out."""
    return _detected(spark, sf_dir).filter("NOT skipped AND repo NOT LIKE 'fix/graph-%'").select("path", F.array_join("why_extractable", " / ").alias("why"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cut_lineage(scoring.score(_detected(spark, sf_dir)))


def fixture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = ["code_quality", "relevance", "usefulness", "maintainability", "uniqueness", "demand_signal", "combined_score", "ship_effort_hours"]
    return _scored(spark, sf_dir).filter("NOT skipped AND repo NOT LIKE 'fix/graph-%' OR path = 'long.py'").select("path", *(F.round(d, 6).alias(d) for d in dims))


def fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = report.summary(_scored(spark, sf_dir), 5.0)
    return counts.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in counts.dtypes))


def fixture_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of each group of repositories, and the first skipped ones."""
    scored = _scored(spark, sf_dir)
    group = W.partitionBy(F.regexp_extract("repo", "[0-9]+$", 0))
    best = scored.filter("NOT skipped").withColumn("n", F.row_number().over(group.orderBy(F.desc("combined_score"), "repo", "path"))).filter("n <= 3")
    passed = scored.filter("skipped").withColumn("n", F.row_number().over(group.orderBy("repo", "path"))).filter("n <= 4")
    best = best.select(F.lit("best").alias("kind"), "repo", "path", F.round("combined_score", 6).cast("string").alias("told"))
    return best.unionByName(passed.select(F.lit("skipped").alias("kind"), "repo", "path", F.col("skip_reason").alias("told")))


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scan.scan_filter(code_fixture(spark, sf_dir))
    path, doc, names = F.col("path"), F.col("docstring_snippet"), F.col("function_names")
    picked = _scored(spark, sf_dir).filter("path IN ('pkg/side.py', 'web/part.tsx', 'rs/inner.rs', 'go/box.go', 'jvm/Box.java', 'src/pair.py')")
    named = picked.withColumns({"suggested_name": naming.suggest_name(path, doc, names), "suggested_tags": naming.suggest_tags(path, F.col("language"), doc)})
    told = named.join(files.select("repo", "path", "content"), ["repo", "path"]).withColumn("what_it_does", describe.described(doc, path, F.col("content"))).drop("content")
    return extract.package_files(told, files, ("A. Nyone", "a@example.org"))


def fixture_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the packages that six candidates become."""
    return _packages(spark, sf_dir).select("repo", "main", "package", "rel_path")


def fixture_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What package managers read, of four languages."""
    wanted = F.col("rel_path").isin("go.mod", "Cargo.toml", "package.json", "index.js") | ((F.col("rel_path") == "pyproject.toml") & (F.col("package") == "side"))
    return _packages(spark, sf_dir).filter(wanted).select("package", "rel_path", "content")


def fixture_relative_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that become notes when a file is lifted out alone."""
    fixed = extract.fix_relative_imports(F.col("content"), F.col("ext"))
    cut = code_fixture(spark, sf_dir).select("repo", "path", F.posexplode(F.split(fixed, "\n")).alias("line", "text"))
    return cut.filter("text LIKE '%TODO%'").select("repo", "path", F.col("line").cast("long").alias("line"), "text")


def _texts(spark: SparkSession, sf_dir: str, rows: list, kind: str) -> DataFrame:
    return fixture.chosen(spark, sf_dir, [r if isinstance(r, tuple) else (r,) for r in rows], kind)


def fixture_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, fixture.TEXTS, "text string").select("doc_id", "no", report.redact_secrets(report.sanitize_markdown(F.col("text"))).alias("clean"))


def fixture_license_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = extract.strip_license_header(F.col("text"))
    return _texts(spark, sf_dir, fixture.HEADERS, "text string").select("doc_id", "no", cut["content"].alias("content"), cut["removed"].cast("long").alias("removed"))


def fixture_token_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scan.scope_check(F.col("status"), F.col("scopes"), F.col("login"), F.col("failure"))
    return _texts(spark, sf_dir, fixture.ANSWERS, "status int, scopes string, login string, failure string").select("doc_id", "no", c["ok"].alias("ok"), c["user"].alias("user_name"), c["error"].alias("error"), c["warning"].alias("warning"), c["is_classic"].alias("is_classic"))


def fixture_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of search responses, and what sets a tested Python file apart from them."""
    found = _texts(spark, sf_dir, fixture.RESPONSES, "body string").withColumn("found", search.parse_response(F.col("body")))
    told = F.transform("found", lambda p: F.concat_ws("|", p["full_name"], p["stars"].cast("string"), p["description"], p["pushed_at"], p["license"], p["open_issues"].cast("string"), p["forks"].cast("string"), p["language"]))
    return found.select("doc_id", "no", F.array_join(told, " / ").alias("projects"), F.array_join(search.differentiators(F.lit("Python"), F.lit(True), F.col("found"), ASOF), " / ").alias("apart"), F.round(scoring.demand(F.col("found")), 6).alias("demand"))


def fixture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, doc, names, first = F.col("path"), F.col("doc"), F.col("functions"), F.col("first_lines")
    rows = _texts(spark, sf_dir, fixture.NAMES, "path string, doc string, functions array<string>, first_lines string")
    return rows.select("doc_id", "no", "path", naming.suggest_name(path, doc, names).alias("name"), _joined(naming.suggest_tags(path, F.lit("Python"), doc)).alias("tags"), naming.search_query(path, doc, names, first).alias("query"))


def fixture_what_it_does(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = code_fixture(spark, sf_dir).filter("repo LIKE 'fix/langs-%'")
    return files.select("path", describe.described(F.lit(""), F.col("path"), F.col("content")).alias("told"))


def fixture_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that make a parser fail are no candidates and are counted."""
    deep = "x = " + "-" * 200_000 + "1\n" + fixture._PY
    files = code_fixture(spark, sf_dir).filter("path IN ('a.py', 'b.py')")
    more = files.filter("path = 'a.py'").select("repo", F.lit("deep.py").alias("path"), "ext", "size", F.lit(deep).alias("content"), "loc")
    found, errors = candidates.examine(files.unionByName(more))
    return found.groupBy("repo").agg(F.count("*").alias("n_candidates")).join(errors.groupBy("repo").agg(F.count("*").alias("n_errors")), "repo")


def fixture_searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored candidates that have met a catalogue; one search is refused."""
    from stratalode import analysis

    catalogue = spark.createDataFrame(
        [(f"o/p{i}", "u", 40 * i, "", "2025-01-01", "MIT", 30, i, "Python", ["side", "work"] if i % 2 else ["inner"]) for i in range(12)] + [("o/old", "u", 9000, "", "2020-01-01", "MIT", 1, 1, "Python", ["side"])],
        search.PROJECT + ", tokens array<string>",
    )
    files = graph.cut_lineage(code_fixture(spark, sf_dir).filter("repo LIKE 'fix/langs-%'"))
    refused = files.filter("path = 'up.py'").select("repo", "path")
    found, _ = analysis.examine(files, "Python", catalogue, ASOF, limited=refused)
    return found.filter("NOT skipped").select(
        "path", "search_status", F.col("similar_count").cast("long").alias("similar_count"), F.array_join(F.transform("similar_projects", lambda p: p["full_name"]), ",").alias("similar"),
        F.round("uniqueness", 6).alias("uniqueness"), F.round("demand_signal", 6).alias("demand_signal"), F.round("combined_score", 6).alias("combined_score"), F.array_join("differentiators", " / ").alias("apart"),
    )


QUERIES = {f.__name__: f for f in (
    fixture_scan, fixture_gates, fixture_signals, fixture_candidates, fixture_reasons, fixture_scores, fixture_summary, fixture_ranked, fixture_packages, fixture_manifests, fixture_relative_notes,
    fixture_clean_text, fixture_license_headers, fixture_token_checks, fixture_responses, fixture_names, fixture_what_it_does, fixture_errors, fixture_searched,
)}
