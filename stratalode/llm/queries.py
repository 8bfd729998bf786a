"""The training-data queries, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import byte_bpe, decontaminate, embedding_dedup, jaccard_join, lexical_search, sharding, substring_dedup, token_counts, token_store, toxicity, url_filter, warc
from stratalode.sources.tables import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that an earlier one has."""
    cut = substring_dedup.substring_dedup(read_table(spark, f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM cut WHERE len(w) >= 50)
), firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM windows JOIN firsts USING (g) WHERE first < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM cut
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of 0.98."""
    return embedding_dedup.link_vectors(read_table(spark, f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS node, b AS seen FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), lowest AS (SELECT node, min(seen) AS m FROM reach GROUP BY node
), counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN lowest ON lowest.node = vec_id LEFT JOIN counts ON counts.node = vec_id
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every 13-word window of the benchmark."""
    found = decontaminate.find_contamination(
        read_table(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


OP3_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM norm, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) GROUP BY doc_id
), held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM norm LEFT JOIN words USING (doc_id) LEFT JOIN held USING (doc_id)
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the host rules, else by the patterns."""
    pages = read_table(spark, f"{sf_dir}/pages.parquet")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) ELSE '' END AS path
  FROM pages
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT cut.*, (SELECT max(struct_pack(n := length(h || p), r := h || p, v := v)) FROM rules
                 WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best
  FROM cut
)
SELECT page_id, host, path, best.r AS rule,
       coalesce(best.v, CASE WHEN regexp_matches(
           translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '\bporn\b|\bxxx\b|\bcasino\b|\bviagra\b|\btorrent\b|/wp-login\.php|/doubleclick/') THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""

def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page written to archives and read back."""
    archives = warc.write_archives(read_table(spark, f"{sf_dir}/pages.parquet"))
    return warc.read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH whole AS (SELECT page_id, coalesce(html, '') AS p, strlen(coalesce(html, '')) AS n FROM pages),
firsts AS (SELECT p, min(page_id) AS first FROM whole WHERE n >= 100 GROUP BY p)
SELECT page_id, n AS payload_bytes, sha256(p) AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM whole LEFT JOIN firsts USING (p)
"""


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to a content-addressed store and read back."""
    store = token_store.write_store(read_table(spark, f"{sf_dir}/documents.parquet"))
    return token_store.read_store(spark, token_store.open_store(store.path))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they are over 4096."""
    counted = token_counts.count_tokens(read_table(spark, f"{sf_dir}/documents.parquet"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks and decoded again."""
    return byte_bpe.round_trip(read_table(spark, f"{sf_dir}/documents.parquet"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labelled rows that are not held out."""
    documents = read_table(spark, f"{sf_dir}/documents.parquet")
    model = toxicity.train_on(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0).alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by a similarity of 0.8 over five-word shingles."""
    return jaccard_join.jaccard_components(read_table(spark, f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT a AS node, b AS seen FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.seen = links.a
), lowest AS (SELECT node, min(seen) AS m FROM reach GROUP BY node)
SELECT cut.doc_id, coalesce(n, 0) AS n_shingles, least(cut.doc_id, coalesce(m, cut.doc_id)) AS component_id
FROM cut LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = cut.doc_id
"""


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in sixteen shards whose numbers of rows differ by one at most, shuffled uniformly."""
    text = F.coalesce("text", F.lit(""))
    narrow = read_table(spark, f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = sharding.shuffle_into_shards(narrow)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item by its words."""
    index = lexical_search.build_index(read_table(spark, f"{sf_dir}/documents.parquet"))
    return lexical_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH held AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), postings AS (SELECT doc_id, t, count(*) AS tf FROM held GROUP BY doc_id, t
), docs AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY doc_id
), totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), spread AS (SELECT doc_id, 20 * (100 - 50 + (50 * n * nn) // ll) AS s FROM docs, totals
), weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY t, nn
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + s))) AS BIGINT) AS score
  FROM asked JOIN weights USING (t) JOIN postings USING (t) JOIN spread USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


QUERIES = {"op9_toxicity": op9_toxicity, "op2_embedding_dedup": op2_embedding_dedup, "op10_jaccard_join": op10_jaccard_join, "op1_substring_dedup": op1_substring_dedup, "op5_warc": op5_warc, "op6_token_store": op6_token_store, "op7_token_counts": op7_token_counts, "op8_byte_bpe": op8_byte_bpe, "op3_benchmark_decontamination": op3_benchmark_decontamination, "op4_url_filters": op4_url_filters, "op11_sharding": op11_sharding, "op12_lexical_search": op12_lexical_search}
SQL = {"op2_embedding_dedup": OP2_SQL, "op10_jaccard_join": OP10_SQL, "op1_substring_dedup": OP1_SQL, "op5_warc": OP5_SQL, "op3_benchmark_decontamination": OP3_SQL, "op4_url_filters": OP4_SQL, "op12_lexical_search": OP12_SQL}
