"""The jobs as queries: each runs its job twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import portfolio_report, watch_repositories
from stratalode.plans.detection_sql import NAMED
from stratalode.plans.oracle import LANG
from stratalode.sources.tables import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_portfolio_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of all repositories with their ranks, and how long each repository's report is sure to be: a line for each."""
    out, config = _folder(spark, "job1"), json.loads(portfolio_report.CONFIG.read_text())
    for _ in range(2):
        portfolio_report.run(spark, f"{sf_dir}/documents.parquet", out, config)
    shown = spark.read.parquet(f"{out}/summary").select("repo", F.col("language").alias("main_language"), "analyzed", "shown")
    lines = spark.read.parquet(f"{out}/reports").select("repo", F.size(F.filter(F.split("report", "\n"), lambda x: x.rlike("^### [0-9]+[.] `"))).cast("long").alias("cards"))
    ranked = spark.read.parquet(f"{out}/ranking")
    return ranked.join(shown, "repo").join(lines, "repo").select(
        "repo", F.col("rank").cast("long").alias("rank"), "path", "language", F.col("loc").cast("long").alias("loc"), F.round("combined_score", 6).alias("combined_score"), "ship_effort_hours",
        "extraction_type", "suggested_name", F.array_join("suggested_tags", ",").alias("tags"), "main_language", "analyzed", "shown", "cards",
    )


def job2_watch_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates as the incremental job keeps them."""
    out, config = _folder(spark, "job2"), json.loads(watch_repositories.CONFIG.read_text())
    for _ in range(2):
        watch_repositories.run(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint", config)
    return spark.read.parquet(f"{out}/candidates").filter("path IS NOT NULL").select(
        "repo", "path", "language", "skipped", "skip_reason", F.col("fan_in").cast("long").alias("fan_in"), "in_cycle", F.round("combined_score", 6).alias("combined_score"), "ship_effort_hours",
        "suggested_name", F.array_join("suggested_tags", ",").alias("tags"), "query",
    )


QUERIES = {f.__name__: f for f in (job1_portfolio_report, job2_watch_repositories)}
SQL = {
    "job1_portfolio_report": f"""{NAMED}, ranks AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY combined_score DESC, path) AS rank FROM named WHERE NOT skipped),
        sums AS (SELECT repo, count(*) AS analyzed, CAST(count_if(NOT skipped) AS BIGINT) AS shown FROM named GROUP BY repo), langs AS (SELECT repo, {LANG} AS language, sum(loc) AS loc FROM all_src GROUP BY 1, 2),
        mains AS (SELECT repo, language FROM langs WHERE language IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY loc DESC, language) = 1)
        SELECT repo, rank, path, ranks.language, loc, round(combined_score, 6) AS combined_score, ship_effort_hours, extraction_type, package AS suggested_name, array_to_string(tags, ',') AS tags,
               mains.language AS main_language, analyzed, shown, least(shown, 10) AS cards FROM ranks JOIN sums USING (repo) JOIN mains USING (repo)""",
    "job2_watch_repositories": f"""{NAMED} SELECT repo, path, language, skipped, skip_reason, fan_in, in_cycle, round(combined_score, 6) AS combined_score, ship_effort_hours, package AS suggested_name,
        array_to_string(tags, ',') AS tags, query FROM named""",
}
