"""Incremental job: candidates of repositories kept up to date as files arrive.

    python -m jobs.watch_repositories DOCUMENTS OUT CHECKPOINT [--config FILE] [--master URL]

DOCUMENTS is a folder that Parquet files of source files (repo, path, content), or of documents, whose
texts then stand for files, are added to. A file stream takes those that are new, and ends when there are no
more; CHECKPOINT holds how far it came. A row is a version of its file; the one that arrived last
counts. Under OUT are Parquet tables:

* ``files``: the latest version of each file by the digest of its content, and the batch it came with;
* ``facts``: what detection takes from a content, by digest; each content is parsed in the batch that
  first has it, never again;
* ``candidates``: scored candidates of all repositories, each row with the batch up to which its repository
  is judged (``upto``, the high-water mark); a repository without candidates has one row without a path.

A new file can change what is said of its neighbours (siblings, tests, who imports whom), so repositories
with a file beyond their mark are judged anew, from files and facts and without any content; others are
left alone. ``files`` and ``candidates`` are partitioned by a hash of the repository and replaced by
partition, ``facts`` by batch. A batch that is taken again after a failure writes the same rows in the same places,
and a repository's candidates and its mark are written in one go.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jobs.portfolio_report import files_of, named
from stratalode.operators import candidates, scan
from stratalode.sources.tables import cut_lineage, replaced, scratch, stream_of, table_or_empty

LOG = logging.getLogger("jobs.watch_repositories")
CONFIG = Path(__file__).with_suffix(".json")
FILES = "repo string, path string, ext string, digest string, gated boolean, kept boolean, license boolean, batch long, part int"
_CONTENT = "digest string, ext string, gated boolean, content string"


def _parts(df: DataFrame) -> list[int]:
    """The parts that rows fall into; there are as many as the config says."""
    return [r["part"] for r in df.select("part").distinct().collect()]


def _versions(files: DataFrame, batch: int, parts: int) -> DataFrame:
    """Rows of ``files`` for the contents of a batch. Of versions that came together the one with the smallest digest counts."""
    keys = candidates.file_keys(files).withColumns({"kept": scan.kept_path(F.col("path"), F.col("ext")), "license": scan.is_license(F.col("path"))})
    plain = files.filter(~scan.generated_header(F.col("content"))).select("repo", "path", F.sha2("content", 256).alias("digest"), F.lit(True).alias("plain")).distinct()
    keys = keys.join(plain, ["repo", "path", "digest"], "left").withColumn("kept", F.col("kept") & F.col("plain").isNotNull())
    one = keys.groupBy("repo", "path").agg(F.min(F.struct("digest", "ext", "gated", "kept", "license")).alias("v"))
    part = F.pmod(F.xxhash64("repo"), F.lit(parts)).cast("int")
    return one.select("repo", "path", "v.ext", "v.digest", "v.gated", "v.kept", "v.license", F.lit(batch).cast("long").alias("batch"), part.alias("part"))


def _facts(spark: SparkSession, out: str) -> DataFrame:
    shape = candidates.content_facts(spark.createDataFrame([], _CONTENT)).schema
    return table_or_empty(spark, f"{out}/facts", StructType([*shape.fields, StructField("batch", LongType())]))


def take(batch: DataFrame, number: int, out: str, parts: int) -> None:
    """One batch of the stream: its files become the latest versions, contents not met before become facts."""
    spark = batch.sparkSession
    with scratch(spark):
        files = files_of(batch).withColumn("content", scan.without_bom(F.col("content")))
        came = cut_lineage(_versions(files, number, parts))
        touched = _parts(came)
        before = table_or_empty(spark, f"{out}/files", FILES).filter(F.col("part").isin(touched))
        # a version that is known already is no news; one of this very batch is taken again
        new = cut_lineage(came.join(before.filter(F.col("batch") < number).select("repo", "path", "digest"), ["repo", "path", "digest"], "left_anti").select(came.columns))
        known = _facts(spark, out).filter(F.col("batch") < number).select("digest", "ext", "gated").join(new.select("digest", "ext").distinct(), ["digest", "ext"], "left_semi")
        # facts of a content that only paths without candidates had are not enough for one that may hold one
        todo = new.filter("kept").join(known.filter("gated").select("digest", "ext"), ["digest", "ext"], "left_anti")
        todo = todo.join(known.filter("NOT gated").select("digest", "ext", F.lit(True).alias("met")).distinct(), ["digest", "ext"], "left").filter("gated OR met IS NULL")
        facts = candidates.content_facts(candidates.distinct_contents(files, todo))
        replaced(facts.withColumn("batch", F.lit(number).cast("long")), f"{out}/facts", "batch")
        old = before.join(new.select("repo", "path"), ["repo", "path"], "left_anti").select(new.columns)
        replaced(cut_lineage(old.unionByName(new)), f"{out}/files", "part")
        LOG.info("batch %d: %d versions of files, %d of them new", number, came.count(), new.count())


def marked(due: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates with the marks of their repositories, which ``due`` has; one row without a path for a repository that
    has none. Marks are sent to the candidates, whose rows need not come together by repository."""
    none = due.join(found.select("repo").distinct(), "repo", "left_anti")
    rows = candidates.told_by_repo(found, due).unionByName(none, allowMissingColumns=True)
    return rows.select(*due.columns, *(c for c in found.columns if c not in due.columns))


def judge(spark: SparkSession, out: str) -> tuple[int, int]:
    """Repositories with files beyond their mark get their candidates anew; returns how many there were, and rows written."""
    table = f"{out}/candidates"
    with scratch(spark):
        files = table_or_empty(spark, f"{out}/files", FILES)
        marks = table_or_empty(spark, table, "repo string, upto long, part int").groupBy("repo").agg(F.max("upto").alias("judged"))
        newest = files.groupBy("repo", "part").agg(F.max("batch").alias("upto"))
        due = cut_lineage(newest.join(marks, "repo", "left").filter("judged IS NULL OR upto > judged").select("repo", "upto", "part"))
        if not (n := due.count()):
            return 0, 0
        parts = _parts(due)
        own = cut_lineage(files.filter(F.col("part").isin(parts)).join(due.select("repo"), "repo", "left_semi"))
        keys = own.filter("kept")
        facts = _facts(spark, out).join(keys.select("digest", "ext").distinct(), ["digest", "ext"], "left_semi")
        # a content may have been met twice, the second time by a path that can be a candidate's
        best = F.max_by(F.struct(*(c for c in facts.columns if c not in ("digest", "ext", "batch"))), F.struct("gated", "batch")).alias("f")
        facts = cut_lineage(facts.groupBy("digest", "ext").agg(best).select("digest", "ext", "f.*"))
        legal = own.groupBy("repo").agg(F.bool_or("license").alias("has_license"))
        found, errors = candidates.judged(keys, facts, keys, legal)
        LOG.info("%d repositories judged, %d files made a parser fail", n, errors.count())
        scored = marked(due, named(found))
        old = table_or_empty(spark, table, scored.schema).filter(F.col("part").isin(parts)).join(due.select("repo"), "repo", "left_anti")
        rows = cut_lineage(old.select(scored.columns).unionByName(scored))
        replaced(rows, table, "part")
        return n, rows.filter("path IS NOT NULL").count()


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Takes what is new in ``documents``; returns how many rows it took, repositories it judged, and candidates it wrote."""
    source = stream_of(spark, documents, config["files_per_batch"])
    taken = [0]

    def one(batch: DataFrame, number: int) -> None:
        take(batch, number, out, config["parts"])
        taken[0] += batch.count()

    stream = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("read %s: %d new rows", documents, taken[0])
    judged, written = judge(spark, out)
    LOG.info("wrote %s/candidates: %d repositories judged, %d candidates written", out, judged, written)
    return {"read": taken[0], "judged": judged, "candidates": written}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="jobs.watch_repositories", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in ("documents", "out", "checkpoint"):
        p.add_argument(name)
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = json.loads(Path(a.config).read_text())
    builder = SparkSession.builder.appName("watch_repositories")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.documents, a.out, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
