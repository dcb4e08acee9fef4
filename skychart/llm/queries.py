"""The operators of this subpackage as queries over the whole given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skychart.llm import (
    ann,
    contamination,
    filteraudit,
    fingerprints,
    hmm,
    jaccard,
    mixing,
    packing,
    periodic,
    quality,
    secretscan,
    sharding,
    toxicity,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_site_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", "text", F.col("source").alias("host"), F.concat_ws("/", "source", "lang").alias("path")
    )
    return quality.judged(docs, quality.fit(docs, table(spark, d, "labels")))


@query
def op2_multiset_hash(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return fingerprints.compared_with_edits(docs)


@query
def op3_kmeans_tree(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return ann.search(vectors, F.col("vec_id") % 20 == 0)


@query
def op4_first_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_digest(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.components(table(spark, d, "documents"), words=4, percent=85)


@query
def op6_hidden_markov(spark: SparkSession, d: str) -> DataFrame:
    return hmm.learned_and_scored(table(spark, d, "documents"))


@query
def op7_byte_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.sized(table(spark, d, "documents"))
    return sharding.contiguous_shards(rows, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op8_nearest_toxic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.scored(docs, model, keep=["doc_id"]).select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
        F.transform("_neighbours", lambda x: x["similarity"]).alias("evidence"),
    )


@query
def op9_forest_secrets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("path"))
    return secretscan.scan(docs, *secretscan.fit(docs))


@query
def op10_source_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents")).select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_ratio").alias("weight"),
        F.col("_probability").alias("probability"),
        F.col("_copies").alias("copies"),
        F.col("_sampled").alias("sampled"),
    )


@query
def op11_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filteraudit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


ORACLES["op11_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS copy
  FROM documents
),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN copy THEN 16 ELSE 0 END AS flags
  FROM d LEFT JOIN said USING (doc_id)
),
counts AS (SELECT part, flags, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(c, b)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0) AS before
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
),
played AS (
  SELECT part, filter_order, step, f, flags, good, toxic, n, flags & f > 0 AS fails, flags & CAST(before AS INTEGER) > 0 AS gone
  FROM steps, counts
),
result AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant, coalesce(sum(n) FILTER (flags = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (fails AND NOT gone AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (fails AND NOT gone AND toxic), 0) AS toxic_lost
  FROM played GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM result
"""


@query
def op12_benchmark_hits(spark: SparkSession, d: str) -> DataFrame:
    docs, benchmark = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark")
    return contamination.scanned(docs, benchmark).select(
        "doc_id",
        "n_words",
        contamination.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op12_benchmark_hits"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS passage
  FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b) WHERE n > 0
),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)),
hits AS (
  SELECT doc_id, i, p.n, item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS passage FROM places) AS p
  JOIN windows USING (n, passage)
),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where about a tenth of the texts repeat a stretch up to their end, as their ids' checksums say."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = (
        docs.select("doc_id", "text", code.alias("_h"), F.when(code % 10 == 0, words).alias("_words"))
        .withColumns({"_n": F.size("_words"), "_g": F.floor(F.col("_h") / 10)})
        .withColumn("_a", F.col("_g") % F.col("_n"))
        .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    )

    def place(i: Column) -> Column:
        return F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")

    repeated = F.array_join(
        F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.get("_words", place(i))), " "
    )
    return cut.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    docs = with_planted_repeats(table(spark, d, "documents"))
    return periodic.digest(periodic.periodic_runs(docs))
