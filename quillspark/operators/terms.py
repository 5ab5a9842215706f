"""Class-based TF-IDF and keywords."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.vectors import as_doubles, dot, mean_vector, normalise
from quillspark.operators.corpus import terms
from quillspark.sources.io import small


def class_counts(frame: DataFrame, column: str, keys: list[str], min_df: int = 1) -> DataFrame:
    """tf of each term and class; min_df counts classes."""
    counts = terms(frame, column, keys).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))
    if min_df <= 1:
        return counts
    wide = counts.groupBy("term").agg(F.count(F.lit(1)).alias("classes")).where(F.col("classes") >= min_df).select("term")
    return counts.join(wide, "term", "left_semi")


def ctfidf(frame: DataFrame, column: str, keys: list[str], min_df: int = 1, reduce_frequent: bool = True) -> DataFrame:
    """keys, term, tf, score: sqrt(tf / class total) * ln(1 + A / term total), A the whole part of the mean class total."""
    counts = class_counts(frame, column, keys, min_df)
    # without a limit on classes the totals need no row per term
    totals = frame.groupBy(*keys).agg(F.sum(F.greatest(F.size(column), F.lit(0))).alias("class_total")).where("class_total > 0") if min_df <= 1 else counts.groupBy(*keys).agg(F.sum("tf").alias("class_total"))
    totals = small(totals.withColumn("a", F.floor(F.avg("class_total").over(Window.partitionBy()))))  # a row per class
    # a term has a row per class at most
    joined = counts.withColumn("term_total", F.sum("tf").over(Window.partitionBy("term"))).join(totals, keys)
    share = F.col("tf") / F.col("class_total")
    weight = F.sqrt(share) if reduce_frequent else share
    return joined.select(*keys, "term", "tf", (weight * F.log1p(F.col("a") / F.col("term_total"))).alias("score"))


def top_class_terms(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best terms of each class with their rank; equal scores (to ten places) go by term, last first."""
    by = Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 10)), F.desc("term"))
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def class_words(frame: DataFrame, column: str, k: int = 8) -> DataFrame:
    """topic, label, n_docs, words of each topic and label."""
    inside = frame.where(F.col("topic").cast("string") != "-1")
    best = top_class_terms(ctfidf(inside, column, ["topic", "label"]), ["topic", "label"], k)
    words = best.groupBy("topic", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), ", ").alias("words"))
    sizes = inside.groupBy("topic", "label").agg(F.count(F.lit(1)).alias("n_docs"))
    return sizes.join(words, ["topic", "label"], "left")


def topic_info(frame: DataFrame, column: str, k: int = 25, min_df: int = 1, reduce_frequent: bool = True, representation: str = "ctfidf", diversity: float = 0.3, vectors: DataFrame | None = None, candidates: int = 100) -> DataFrame:
    """topic, n, words, word_scores of each topic.

    Representation "mmr" chooses the words greedily among twice as many; "keybert" takes, of the `candidates` best ones,
    those nearest to the representative documents, by vectors (doc_id, embedding) of the documents.
    """
    wide = representation == "mmr"
    best = top_class_terms(ctfidf(frame, column, ["topic"], min_df, reduce_frequent), ["topic"], 2 * k if wide else candidates if representation == "keybert" else k)
    if representation == "keybert":
        placed = frame.join(vectors.select("doc_id", "embedding"), "doc_id")
        asked = small(best.select("topic", F.col("term").alias("word")))  # a few words of each topic
        near = keybert(asked, word_vectors(placed, asked, column), representative_vectors(placed), k)
        best = near.select("topic", F.col("word").alias("term"), F.col("similarity").alias("score"), "rank")
    if wide:
        best = small(best.select("topic", "term", "score", "rank"))  # a few words of each topic
        vectors = small(hashed_vectors(best.select("topic", F.col("term").alias("word"), "score"), "word"))
        # a topic is near its words, by their scores
        means = vectors.select("topic", "score", F.posexplode("embedding").alias("at", "x")).groupBy("topic", "at").agg(F.sum(F.col("score") * F.col("x")).alias("x"))
        topic = means.groupBy("topic").agg(normalise(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"])).alias("topic_embedding"))
        chosen = maximal_marginal_relevance(vectors.join(topic.where("topic_embedding is not null"), "topic").select("topic", "word", "embedding", "topic_embedding"), k, diversity)
        best = best.drop("rank").join(chosen.withColumnRenamed("word", "term"), ["topic", "term"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term", "score")))
    words = best.groupBy("topic").agg(ordered.alias("w")).select("topic", F.transform("w", lambda s: s["term"]).alias("words"), F.transform("w", lambda s: s["score"]).alias("word_scores"))
    return frame.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).join(words, "topic", "left")


def topic_names(info: DataFrame, k: int = 4) -> DataFrame:
    return info.select("topic", F.array_join(F.slice("words", 1, k), ", ").alias("name"))


def maximal_marginal_relevance(candidates: DataFrame, k: int, diversity: float) -> DataFrame:
    """topic, rank, word: greedy choice of near but different words among a bounded list of candidates a topic.

    candidates: topic, word, embedding, topic_embedding (unit vectors). The first is the nearest to the topic; each next
    one maximises (1 - diversity) * similarity to the topic - diversity * largest similarity to a chosen one.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("word", kind="stable").reset_index(drop=True)
        words = np.array(frame["embedding"].tolist(), float)
        near = words @ np.array(frame["topic_embedding"].iloc[0], float)
        among, chosen = words @ words.T, [int(near.argmax())]
        while len(chosen) < min(k, len(frame)):
            value = (1 - diversity) * near - diversity * among[:, chosen].max(axis=1)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"topic": frame["topic"].iloc[0], "rank": range(1, len(chosen) + 1), "word": frame["word"].iloc[chosen].to_numpy()})

    return candidates.groupBy("topic").applyInPandas(choose, "topic int, rank int, word string")


def representative_vectors(frame: DataFrame, representatives: int = 5, vector: str = "embedding", key: str = "doc_id") -> DataFrame:
    """topic, topic_embedding: the unit mean of the vectors of the documents nearest to each topic's centre; each task keeps a few per topic."""
    centres = small(mean_vector(frame, ["topic"], vector).withColumn("centroid", normalise(F.col("centroid"))))  # a row per topic
    near = F.round(dot(normalise(as_doubles(F.col(vector))), F.col("centroid")), 8)
    by = Window.partitionBy("topic").orderBy(F.desc("_near"), key)
    chosen = frame.join(centres, "topic").withColumn("_near", near).where("_near is not null").withColumn("_place", F.row_number().over(by)).where(F.col("_place") <= representatives)
    return mean_vector(chosen, ["topic"], vector).select("topic", normalise(F.col("centroid")).alias("topic_embedding")).where("topic_embedding is not null")


def word_vectors(frame: DataFrame, words: DataFrame, column: str, vector: str = "embedding") -> DataFrame:
    """word, embedding: for each of a few words (column word) the unit mean of the vectors of the documents that hold it."""
    first = frame.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
    size = first[0] if first else 0
    held = frame.where(F.col(vector).isNotNull()).select(F.explode(F.array_distinct(column)).alias("word"), F.col(vector).alias("_v")).join(small(words.select("word").distinct()), "word")
    means = held.groupBy("word").agg(*(F.avg(F.col("_v")[i].cast("double")).alias(f"m{i}") for i in range(size)))
    return means.select("word", normalise(F.array(*(F.col(f"m{i}") for i in range(size))).cast("array<double>")).alias("embedding")).where("embedding is not null")


def keybert(candidates: DataFrame, words: DataFrame, topics: DataFrame, k: int) -> DataFrame:
    """topic, rank, word, similarity: of each topic's candidates (topic, word) the k nearest to the topic's representative documents.

    words: word, embedding; topics: topic, topic_embedding; unit vectors. Equal similarities (to eight places) go by word.
    """
    met = candidates.select("topic", "word").join(small(words), "word").join(small(topics), "topic")
    scored = met.select("topic", "word", F.round(dot(F.col("embedding"), F.col("topic_embedding")), 8).alias("similarity"))
    by = Window.partitionBy("topic").orderBy(F.desc("similarity"), "word")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("topic", "rank", "word", "similarity")


def hashed_vectors(frame: DataFrame, column: str, size: int = 64) -> DataFrame:
    """A unit vector of character trigrams for each word, without a model: adds embedding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for batch in batches:
            vectors = np.zeros((len(batch), size))
            for i, word in enumerate(batch[column]):
                padded = f"^{word}$"
                for a in range(len(padded) - 2):
                    h = zlib.crc32(padded[a : a + 3].encode())
                    vectors[i, h % size] += 1 if h & 65536 else -1
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield batch.assign(embedding=list(vectors / np.where(norm > 0, norm, 1)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInPandas(run, f"{fields}, embedding array<double>")
