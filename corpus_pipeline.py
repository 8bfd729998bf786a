"""The corpus pipeline: five stages over documents, each a training-data operator.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept;
what it decides takes effect. All but the last return the columns of documents.

1. toxicity: documents that the model rejects go. It learns from labelled rows of the
   documents it is given, by the operator's own bound.
2. near_duplicates: of each group of linked documents the one with the smallest id stays.
3. substring_dedup: passages that an earlier document has go from the text. A document
   that loses nothing keeps its text as it is; one of which nothing is left goes.
4. decontamination: documents that are contaminated by the benchmark go.
5. byte_bpe: ids of the texts that are left, and what they decode to.

Documents without a text hold nothing to judge and stay until they are encoded as
empty; documents without an id are in no group and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import byte_bpe, decontaminate, jaccard_join, substring_dedup, toxicity
from stratalode.llm._shared import dropped, shared_path
from stratalode.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = toxicity.score(docs.select(COLUMNS), model, keep=True).filter(F.col("score") < toxicity.REJECT)
    return kept.select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.jaccard_components(docs)
    stay = groups.filter("component_id = doc_id").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(COLUMNS).unionByName(docs.filter("doc_id IS NULL").select(COLUMNS))


def cut_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(docs.select(COLUMNS), keep=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    left = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", text)
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return found.filter(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_substrings),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL can express neither the model's scores nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written, read again, and removed once the next stage's are written."""
    docs, before = read_table(spark, f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = shared_path(spark, name)
        kept.write.parquet(path)
        dropped(*before)
        docs = spark.read.schema(kept.schema).parquet(path)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
