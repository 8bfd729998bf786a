"""One repository from its files to scored, named candidates that have met similar projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.operators import candidates, describe, naming, report, scan, scoring, search
from stratalode.sources.files import from_directory

NOT_SEARCHED = "Similar projects were not looked for"


def examine(
    files: DataFrame, language: str | None = None, projects: DataFrame | None = None, asof: str | None = None, min_stars: int = 5, limited: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scored candidates with names, tags, a line on what each does, similar projects and what sets it
    apart from them; and the files that made a parser fail (repo, path, error).

    Licences are looked for before the language filter, siblings and tests after it. ``projects`` is
    the catalogue to compare with on the day ``asof``; without it the comparison is left out.
    ``limited`` (repo, path) are candidates whose search was refused.
    """
    legal = scan.licenses(files)
    seen = scan.of_language(files, language) if language else files
    found, errors = candidates.examine(seen, legal)
    path, doc, names = F.col("path"), F.col("docstring_snippet"), F.col("function_names")
    if projects is not None:
        found = search.with_similar(found.withColumn("query", naming.search_query(path, doc, names, F.col("first_lines"))), projects, asof, min_stars, limited)
        apart = search.differentiators(F.col("language"), F.col("has_tests"), F.col("similar_projects"), asof, F.col("search_status") == "rate_limited")
    else:
        apart = F.array(F.lit(NOT_SEARCHED))
    scored = scoring.score(found).withColumn("differentiators", F.when(~F.col("skipped"), apart))
    named = scored.withColumns({"suggested_name": naming.suggest_name(path, doc, names), "suggested_tags": naming.suggest_tags(path, F.col("language"), doc)})
    told = named.join(seen.select("repo", "path", "content"), ["repo", "path"], "left")
    return told.withColumn("what_it_does", F.when(F.col("skipped"), "").otherwise(describe.described(doc, path, F.col("content")))).drop("content"), errors


def analyze_repo(
    spark: SparkSession, folder: str, repo: str, max_candidates: int = 10, min_stars: int = 5, language: str | None = None, projects: DataFrame | None = None, asof: str | None = None
) -> DataFrame:
    """The best candidates of a checked-out repository, best first."""
    found, _ = examine(from_directory(spark, folder, repo), language, projects, asof, min_stars)
    return report.ranked(found, max_candidates)
