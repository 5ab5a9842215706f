"""Stage tables derived from the shared tables, once as DataFrames and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import ngrams, ngrams_interleaved, tokens
from quillspark.sources.io import spread, table

#: Appended to texts so that each preparation rule has something to do.
TRIGGER = " géniaaaal ŒUVRE cœur 8/10 12 / 20 aaa"
#: Stop words of the token queries: fixed values.
STOP = ["the", "and", "of", "de", "la", "le", "der", "und", "el", "que"]


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, review, label, topic, topic_raw, topic_out, embedding."""
    docs, labels, vectors = (table(spark, d, n) for n in ("documents", "labels", "embeddings"))
    joined = docs.select("doc_id", F.col("text").alias("review")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")
    joined = joined.join(vectors.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"), "embedding"), "doc_id")
    return joined.withColumn("topic_raw", F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("topic"))).withColumn("topic_out", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("topic")))


def with_outliers(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).withColumn("topic", F.col("topic_out"))


def classes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, review, label, topic: sources as topics."""
    docs, labels = spread(table(spark, d, "documents")), table(spark, d, "labels")
    return docs.select("doc_id", F.col("text").alias("review"), F.col("source").alias("topic")).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id")


def two_sided(spark: SparkSession, d: str) -> DataFrame:
    """Languages as topics; the label says whether the text has one of three accented letters."""
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("review"), F.col("lang").alias("topic"), F.col("text").rlike("[éáí]").cast("int").alias("label"))


def one_sided(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic"), (e[0] > e[1]).cast("int").alias("label"))


def tokenized(spark: SparkSession, d: str) -> DataFrame:
    """classes() with tokens, grams (deduped uni- and bigrams) and stream (interleaved)."""
    # a text with a token; a filter on the tokens would make them twice
    t = classes(spark, d).where(F.lower("review").rlike(r"(?U)\p{L}{2}")).withColumn("tokens", tokens(F.col("review")))
    return t.withColumn("grams", ngrams(F.col("tokens"), True)).withColumn("stream", ngrams_interleaved(F.col("tokens")))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("topic"))


REVIEWS = """reviews AS (SELECT d.doc_id, d.text AS review, l.quality AS label, e.label AS topic, e.embedding,
  CASE WHEN d.doc_id % 5 = 0 THEN -1 ELSE e.label END AS topic_raw, CASE WHEN d.doc_id % 7 = 0 THEN -1 ELSE e.label END AS topic_out
  FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id)"""
CLASSES = "classes AS (SELECT d.doc_id, d.text AS review, d.source AS topic, l.quality AS label FROM documents d JOIN labels l USING (doc_id))"
TWO_SIDED = "two AS (SELECT doc_id, lang AS topic, regexp_matches(text, '[éáí]')::INT AS label FROM documents)"
ONE_SIDED = "one AS (SELECT vec_id AS doc_id, label AS topic, (embedding[1] > embedding[2])::INT AS label FROM embeddings)"
TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}]+'), lambda x: length(x) >= 2)"
BIGRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
TOKENIZED = f"""{CLASSES}, tokenized AS (SELECT *, {TOKENS.format("review")} AS tokens FROM classes),
 grams AS (SELECT doc_id, topic, label, tokens, list_concat(tokens, {BIGRAMS.format("tokens")}) AS all_grams,
  flatten(list_transform(range(1, len(tokens) + 1), lambda i: CASE WHEN i < len(tokens) THEN [tokens[i], tokens[i] || ' ' || tokens[i + 1]] ELSE [tokens[i]] END)) AS stream
  FROM tokenized WHERE len(tokens) > 0)"""
