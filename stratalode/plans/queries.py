"""Queries over the file table made from documents, and over other tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.functions import languages as L
from stratalode.functions.text import lines, parent, stem, strip
from stratalode.operators import candidates, chunks, describe, extract, graph, naming, report, resolve, scan, scoring, search
from stratalode.plans import fixture_queries
from stratalode.plans.corpus import source_files
from stratalode.plans.fixture import TEXTS
from stratalode.sources.tables import read_table

ASOF = "2025-06-30"
Query = Callable[[SparkSession, str], DataFrame]


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = source_files(spark, sf_dir).withColumns({"fam": L.family(F.col("ext")), "lines": lines(F.col("content"))})
    return files.filter("fam IS NOT NULL").withColumn("stripped", F.transform("lines", strip))


def loc_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and files of each repository and language."""
    return scan.loc_by_language(source_files(spark, sf_dir))


def primary_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's language with most lines."""
    return scan.primary_language(source_files(spark, sf_dir))


def scan_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a scan keeps."""
    return scan.scan_filter(source_files(spark, sf_dir)).select("repo", "path", "size", "loc")


def hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that may hold a candidate by their path."""
    return source_files(spark, sf_dir).filter(scan.hard_gate(F.col("path"), F.col("ext"))).select("repo", "path")


def filename_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What file names tell, and which are routes of a framework."""
    path = F.col("path")
    return source_files(spark, sf_dir).select("repo", "path", scan.filename_score(path).alias("filename_score"), scan.framework_route(path).alias("is_route"))


def license_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories with a licence file at their root."""
    return scan.licenses(source_files(spark, sf_dir))


def logical_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are neither blank nor comment."""
    return _lined(spark, sf_dir).select("repo", "path", L.logical_loc(F.col("fam"), F.col("stripped")).alias("loc"))


def chunked_loc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from files that are cut into rows of seven lines."""
    return chunks.logical_loc(chunks.cut(source_files(spark, sf_dir), 7))


def comment_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment lines over all lines."""
    return _lined(spark, sf_dir).select("repo", "path", F.round(L.comment_ratio(F.col("fam"), F.col("stripped")), 6).alias("comment_ratio"))


def external_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules that files import, in order."""
    found = L.external_imports(F.col("fam"), F.col("lines"))
    return _lined(spark, sf_dir).select("repo", "path", F.posexplode(found).alias("pos", "module")).withColumn("pos", F.col("pos").cast("long"))


def dependency_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest module that a file imports, and whether all are of the standard library."""
    weight = L.dependency_weight(F.col("fam"), L.external_imports(F.col("fam"), F.col("lines")))
    return _lined(spark, sf_dir).select("repo", "path", weight["weight"].alias("weight"), weight["stdlib_only"].alias("stdlib_only"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all families; only Python and Go contents go through a parser."""
    files = source_files(spark, sf_dir).withColumn("fam", L.family(F.col("ext"))).filter("fam IS NOT NULL")
    return files.withColumn("p", L.parsed(F.col("fam"), F.when(F.col("fam").isin(L.by_parser()), F.col("content"))))


def public_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of public declarations of every file, in order."""
    found = F.when(F.col("fam") == "python", F.col("p.names")).otherwise(L.public_api(F.col("fam"), F.col("content")))
    return _parsed(spark, sf_dir).select("repo", "path", F.size(found).cast("long").alias("n"), F.array_join(found, ",").alias("names"))


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more than the branches of every file."""
    total = F.when(F.col("fam") == "python", F.col("p.complexity")).otherwise(L.complexity(F.col("fam"), F.col("content")))
    return _parsed(spark, sf_dir).select("repo", "path", total.cast("long").alias("complexity"))


def _relative() -> Column:
    return F.when(F.col("fam") == "python", F.col("p.relative")).otherwise(L.relative_imports(F.col("fam"), F.col("content")))


def relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of neighbours: name and how many folders up."""
    return _parsed(spark, sf_dir).select("repo", "path", F.explode(_relative()).alias("item")).select("repo", "path", "item.name", F.col("item.level").cast("long").alias("level"))


def python_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax trees: public names, complexity and relative imports of Python files."""
    files = source_files(spark, sf_dir).filter("ext = '.py'").select("repo", "path", L.parsed(F.lit("python"), F.col("content")).alias("p"))
    return files.select("repo", "path", F.array_join("p.names", ",").alias("names"), F.col("p.complexity").cast("long").alias("complexity"), F.size("p.relative").cast("long").alias("n_relative"))


def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation of every file; Go's goes through a parser."""
    told = F.when(F.col("fam") == "go", F.col("p.doc")).otherwise(L.docstring(F.col("fam"), F.col("lines"), F.col("stripped")))
    files = _lined(spark, sf_dir).withColumn("p", L.parsed(F.col("fam"), F.when(F.col("fam") == "go", F.col("content"))))
    return files.select("repo", "path", told.alias("docstring"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which Python file imports which."""
    return graph.import_edges(graph.import_graph(source_files(spark, sf_dir)))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files import each Python file."""
    files = source_files(spark, sf_dir)
    return graph.fan_in(files, graph.import_graph(files)).withColumn("fan_in", F.col("fan_in").cast("long"))


def import_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files that import each other in a circle."""
    return graph.import_cycles(graph.import_graph(source_files(spark, sf_dir)))


def sibling_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings that files import; what is not found is missing."""
    found = resolve.resolve_siblings(_parsed(spark, sf_dir).select("repo", "path", "fam", _relative().alias("relative")), source_files(spark, sf_dir))
    return found.select("repo", "path", F.array_join("sibling_paths", ",").alias("sibling_paths"), F.array_join("missing", ",").alias("missing"))


def has_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that have a test."""
    return resolve.tested(source_files(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table, made and written once where it is read more than once."""
    return graph.cut_lineage(source_files(spark, sf_dir))


def _candidates(whole: DataFrame) -> DataFrame:
    return candidates.detect(scan.scan_filter(whole), scan.licenses(whole))


def detect_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate, active or skipped, with its signals; lists as text."""
    found = _candidates(_written(spark, sf_dir))
    kept = [F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c).cast("long").alias(c) if t == "int" else F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]
    return found.select(*kept)


def scored_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with score, effort, name, tags and search words."""
    scored = scoring.score(_candidates(_written(spark, sf_dir)))
    path, doc, names = F.col("path"), F.col("docstring_snippet"), F.col("function_names")
    return scored.select("repo", "path", "skipped", F.round("combined_score", 6).alias("combined_score"), "ship_effort_hours", naming.suggest_name(path, doc, names, F.col("skipped")).alias("suggested_name"), F.array_join(naming.suggest_tags(path, F.col("language"), doc), ",").alias("tags"), naming.search_query(path, doc, names, F.col("first_lines")).alias("query"))


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of each repository over candidates that score 5 or more."""
    told = report.summary(scoring.score(_candidates(_written(spark, sf_dir))), 5.0)
    return told.withColumn("avg_complexity", F.round("avg_complexity", 6))


def report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates."""
    return report.ranked(scoring.score(_candidates(_written(spark, sf_dir)))).select("repo", "path", F.round("combined_score", 6).alias("combined_score"))


def extract_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the packages that the best five candidates become."""
    whole = _written(spark, sf_dir)
    files = scan.scan_filter(whole)
    scored = graph.cut_lineage(scoring.score(_candidates(whole)))
    named = scored.withColumns({"suggested_name": naming.suggest_name(F.col("path"), F.col("docstring_snippet"), F.col("function_names")), "suggested_tags": naming.suggest_tags(F.col("path"), F.col("language"), F.col("docstring_snippet"))})
    picked = graph.cut_lineage(extract.chosen(named, 5, 4.0))
    files = extract.needed_files(picked, files)
    told = picked.join(files, ["repo", "path"]).withColumn("what_it_does", describe.described(F.col("docstring_snippet"), F.col("path"), F.col("content"))).drop("content")
    return extract.package_files(told, files).select("repo", "package", "rel_path")


def fix_relative_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents with imports of neighbours turned into notes."""
    fixed = extract.fix_relative_imports(F.col("content"), F.col("ext"))
    return source_files(spark, sf_dir).select("repo", "path", F.sha2(fixed, 256).alias("fixed_sha256"))


def sanitize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, each with a line that may hold an obviously false secret, without scripts, fences that close, or secrets."""
    lined = F.concat(F.col("html"), F.lit("\n"), F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("page_id") % len(TEXTS) + 1).cast("int")))
    clean = report.redact_secrets(report.sanitize_markdown(lined))
    return read_table(spark, f"{sf_dir}/pages.parquet").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.sha2(clean, 256).alias("clean_sha256"))


def signal_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as scoring inputs, by modular arithmetic over boundary values."""
    items = read_table(spark, f"{sf_dir}/lineitem.parquet")
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber")

    def pick(values: list, by: int) -> Column:
        return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.floor(key / by), F.lit(len(values))) + 1).cast("int"))

    flag = lambda by: F.pmod(F.floor(key / by), F.lit(2)) == 1
    none = F.array().cast("array<string>")
    return items.select(
        "l_orderkey", "l_linenumber", F.lit("pkg/cache.py").alias("path"), pick(LOCS, 1).alias("loc"), pick(FANS, 2).alias("fan_in"), pick(CCS, 3).alias("complexity"), pick([0, 1, 2, 3], 5).alias("api_surface_count"),
        pick([0, 1, 3], 7).alias("dependency_weight"), pick([0, 1], 4).alias("internal_imports"), pick([0, 3, 4, 5, 6], 6).alias("external_imports"), pick([0.0, 0.5, -0.5], 9).alias("filename_score"), pick([0.0, 0.04, 0.05, 0.15], 8).alias("comment_ratio"),
        flag(3).alias("has_tests"), flag(5).alias("has_docstring"), flag(11).alias("in_cycle"), flag(13).alias("has_project_specific_refs"), flag(17).alias("is_stdlib_only"), flag(19).alias("source_has_license"),
        F.when(flag(2), "multi").otherwise("single").alias("extraction_type"), none.alias("relative_imports"),
        F.when(flag(7), F.array(F.lit("parse_it"))).otherwise(F.array(F.lit("a_b_c_d_e"))).alias("function_names"), pick([-1, 0, 1, 2, 3, 5, 6], 10).alias("similar_count"),
    )


LOCS, FANS, CCS = [9, 10, 19, 20, 49, 50, 149, 150, 200, 201, 299, 300, 301, 400, 401, 499, 500, 501, 650, 651, 2000], [-1, 0, 10, 11, 20, 21, 50, 51], [0, 5, 6, 10, 11, 15, 16, 20, 21]


def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dimensions of the score over boundary values."""
    dims = ["code_quality", "relevance", "usefulness", "maintainability", "uniqueness", "combined_score"]
    scored = scoring.score(signal_grid(spark, sf_dir))
    return scored.select("l_orderkey", "l_linenumber", *(F.round(d, 6).alias(d) for d in dims), "ship_effort_hours")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue of similar projects made from parts."""
    key = F.col("p_partkey")
    langs = F.array(*(F.lit(x) for x in ("Python", "JavaScript", "Go", "Ruby")))
    day = F.date_sub(F.lit(ASOF).cast("date"), (key % 1000).cast("int")).cast("string")
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("acme/p"), key.cast("string")).alias("full_name"), F.concat(F.lit("https://example.org/p"), key.cast("string")).alias("html_url"), (key * 37 % 3000).alias("stars"), F.lit("").alias("description"),
        F.when(key % 13 == 0, "soon").otherwise(day).alias("pushed_at"), F.lit("MIT").alias("license"), (key * 7 % 60).alias("open_issues"), (key * 11 % 90).alias("forks"), F.element_at(langs, (key % 4 + 1).cast("int")).alias("language"),
        F.array(F.concat(F.lit("t"), (key % 5).cast("string")), F.concat(F.lit("u"), (key % 3).cast("string"))).alias("tokens"),
    )


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    langs = F.array(*(F.lit(x) for x in ("Python", "JavaScript", "Go", "Ruby")))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("acme/repo").alias("repo"), key.cast("string").alias("path"), F.element_at(langs, (key % 4 + 1).cast("int")).alias("language"), F.concat(F.lit("t"), (key % 5).cast("string"), F.lit(" x")).alias("query"))


def similar_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best similar projects of each candidate."""
    return search.similar_projects(_wanted(spark, sf_dir), projects(spark, sf_dir), ASOF).select("path", F.col("rank").cast("long").alias("rank"), "full_name", "stars")


def demand_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demand, months since the best was pushed, and the stale share, from the five best."""
    top = search.similar_projects(_wanted(spark, sf_dir), projects(spark, sf_dir), ASOF)
    row = F.struct("rank", "stars", "forks", "open_issues", "pushed_at", "full_name", "language")
    listed = top.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("similar"))
    stale = F.size(F.filter("similar", lambda p: F.coalesce(search.months_since(p["pushed_at"], ASOF) > 12, F.lit(False))))
    return listed.select("path", F.round(scoring.demand(F.col("similar")), 6).alias("demand"), search.months_since(F.col("similar")[0]["pushed_at"], ASOF).cast("long").alias("months"), stale.cast("long").alias("stale"))


ARG_FORMS = ["{}", "https://github.com/{}", "https://www.github.com/{}.git", "git@github.com:{}.git", "http://github.com/{}/", "http://example.org/{}", "git@example.org:{}.git", "{}/more", "{}.git", " {} "]
SCOPES = ["", "read:org", " repo", "write:packages", "admin:org", "delete_repo", "public_repo", "user:email", "delete:packages", "gist"]


def repo_arg_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners and names of repository arguments: customers own their nation's repository, in one of ten forms; some names are empty."""
    key = F.col("c_custkey")
    owner = F.when(key % 17 == 3, "").otherwise(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]+", "-"))
    plain = F.concat(owner, F.lit("/n"), F.col("c_nationkey").cast("string"))
    arg = F.when(key % 19 == 4, "").otherwise(F.replace(F.element_at(F.array(*map(F.lit, ARG_FORMS)), (key % 10 + 1).cast("int")), F.lit("{}"), plain))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", arg.alias("arg"))
    return rows.select("c_custkey", "arg", scan.parse_repo_arg(F.col("arg")).alias("p")).select("c_custkey", "arg", "p.owner", "p.name", F.col("p.error").isNull().alias("fits"))


def scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to token checks, by events: status, a list of scopes, or no answer at all."""
    key = F.col("event_id")
    pick = lambda by: F.element_at(F.array(*map(F.lit, SCOPES)), (F.floor(key / by) % 10 + 1).cast("int"))
    status = F.when(key % 5 == 1, 401).when(key % 5 == 2, 403).when(key % 35 == 3, 500).otherwise(200)
    header = F.when(key % 3 == 0, F.concat_ws(",", pick(1), pick(10))).when(key % 3 == 1, pick(100))
    rows = read_table(spark, f"{sf_dir}/events.parquet").select("event_id", status.alias("status"), header.alias("scopes"), F.when(key % 29 == 0, "timed out").alias("failure"), F.col("user_id").cast("string").alias("login"))
    c = scan.scope_check(F.col("status"), F.col("scopes"), F.col("login"), F.col("failure"))
    return rows.select("event_id", F.array_join(scan.write_scopes(F.col("scopes")), ",").alias("offending"), c["ok"].alias("ok"), c["user"].alias("user_name"), c["error"].alias("error"), c["warning"].alias("warning"), c["is_classic"].alias("is_classic"))


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how many of their first 30 lines speak of licences."""
    legal = F.filter(F.slice(lines(F.col("text")), 1, 30), lambda x: F.lower(x).rlike("copyright|licensed under|apache license|mit license|permission is hereby granted"))
    return read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.size(legal).cast("long").alias("n_legal"), F.size(lines(F.col("text"))).cast("long").alias("n_lines"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems and folders of paths."""
    return source_files(spark, sf_dir).select("repo", "path", stem(F.col("path")).alias("stem"), parent(F.col("path")).alias("parent"))


QUERIES: dict[str, Query] = fixture_queries.QUERIES | {f.__name__: f for f in (
    loc_by_language, primary_language, scan_filters, hard_gates, filename_score, license_present, logical_loc, chunked_loc, comment_ratio, external_imports,
    dependency_weight, public_api, complexity, relative_imports, python_metrics, docstrings, import_edges, fan_in, import_cycles, sibling_resolution,
    has_test, detect_candidates, scored_candidates, report_summary, report_top, extract_plan, fix_relative_imports, sanitize_pages, score_grid,
    similar_top5, demand_signal, repo_arg_parse, scope_check, license_lines, path_parts,
)}
