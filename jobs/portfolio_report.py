"""Batch job: what could be lifted out of all repositories of a portfolio.

    python -m jobs.portfolio_report DOCUMENTS OUT [--config FILE] [--master URL]

DOCUMENTS is a Parquet table of source files (repo, path, content) or of documents, whose texts then
stand for files. The job detects and scores candidates of every repository and writes Parquet tables
under OUT, each partitioned by language; a run replaces the tables of the one before:

* ``ranking``: a row for each active candidate, with its rank in its repository and what it scores;
* ``summary``: a row for each repository, by its main language;
* ``reports``: a Markdown report on each repository, by its main language.

The same input gives the same output; a run that is repeated or was broken off replaces what it finds.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.operators import candidates, describe, naming, report, scan, scoring
from stratalode.plans.corpus import as_files
from stratalode.sources.files import from_table
from stratalode.sources.tables import cut_lineage, replaced, scratch

LOG = logging.getLogger("jobs.portfolio_report")
CONFIG = Path(__file__).with_suffix(".json")
RANKING = ["repo", "rank", "path", "combined_score", "ship_effort_hours", "loc", "extraction_type", "suggested_name", "suggested_tags", "language"]


def files_of(table: DataFrame) -> DataFrame:
    """A table of files as it is, documents as the files they stand for."""
    return from_table(table) if {"repo", "path", "content"} <= set(table.columns) else as_files(table)


def named(found: DataFrame) -> DataFrame:
    """Candidates with scores, names and tags."""
    path, doc, names = F.col("path"), F.col("docstring_snippet"), F.col("function_names")
    return scoring.score(found).withColumns({
        "suggested_name": naming.suggest_name(path, doc, names, F.col("skipped")), "suggested_tags": naming.suggest_tags(path, F.col("language"), doc),
        "query": naming.search_query(path, doc, names, F.col("first_lines")),
    })


def run(spark: SparkSession, documents: str, out: str, config: dict) -> dict[str, int]:
    """Reads ``documents``, writes the three tables under ``out``; returns how many rows it read and wrote."""
    most, least = config["max_candidates"], config["min_score"]
    with scratch(spark):
        table = spark.read.parquet(documents)
        LOG.info("read %s: %d rows", documents, read := table.count())
        files = cut_lineage(files_of(table))  # documents are made into files once
        kept = scan.scan_filter(files)
        found, errors = candidates.examine(kept, scan.licenses(files))
        scored = cut_lineage(named(found))
        LOG.info("%d files made a parser fail", failed := errors.count())
        main = cut_lineage(scan.primary_language(files))
        tables = {
            "ranking": replaced(report.placed(scored, least).select(RANKING), f"{out}/ranking", "language", whole=True),
            "summary": replaced(report.summary(scored, least).join(main, "repo"), f"{out}/summary", "language", whole=True),
        }
        # contents are needed once more, for the line on what each card's file does
        cards = cut_lineage(tables["ranking"].filter(F.col("rank") <= most).select("repo", "path"))
        told = kept.select("repo", "path", "content").join(cards, ["repo", "path"], "left_semi").join(scored.select("repo", "path", "docstring_snippet"), ["repo", "path"])
        told = told.select("repo", "path", describe.described(F.col("docstring_snippet"), F.col("path"), F.col("content")).alias("what_it_does"))
        whole = scored.join(told, ["repo", "path"], "left").withColumn("what_it_does", F.coalesce("what_it_does", F.lit("")))
        pages = report.reports(whole, main, config["generated"], most, least)
        tables["reports"] = replaced(pages.join(main, "repo"), f"{out}/reports", "language", whole=True)
    counts = {"read": read, "errors": failed} | {name: t.count() for name, t in tables.items()}
    LOG.info("wrote %s", ", ".join(f"{out}/{t}: {counts[t]} rows" for t in tables))
    return counts


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.portfolio_report", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("documents")
    p.add_argument("out")
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(a.config).read_text())
    builder = SparkSession.builder.appName("portfolio_report")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.documents, a.out, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
