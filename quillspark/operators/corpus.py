"""Corpus tables: cleaned and tokenized reviews, vocabulary, bags of words, exploration aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.config import EXTRA_STOPWORDS, SENTIMENT_WORDS, Config
from quillspark.functions.text import NOISE, clean_text, keep_tokens, match_context, prepare_for_tokens, tokens, unicode_classes, word_count

Lemmatizer = Callable[[Column], Column]


def stopwords(spark: SparkSession, config: Config) -> list[str]:
    """The French list, the words without topical value and, if set, those that carry the sentiment; in lower case, sorted."""
    words = {*StopWordsRemover.loadDefaultStopWords("french"), *EXTRA_STOPWORDS}
    if config.remove_sentiment_words:
        words |= {*SENTIMENT_WORDS}
    return sorted(w.lower() for w in words)


def build_corpus(reviews: DataFrame, config: Config, lemma: Lemmatizer | None = None) -> DataFrame:
    """doc_id, review, label, text_clean, tokens, n_tokens of the reviews with enough tokens.

    lemma maps a token column to its lemma (default: lower case).
    """
    stop = stopwords(reviews.sparkSession, config)
    cleaned = reviews.withColumn("text_clean", clean_text(F.col("review")))
    surface = F.filter(F.split(prepare_for_tokens(F.col("text_clean")), r"(?U)[^\p{L}]+"), lambda t: t != "")
    if config.remove_persons:
        surface = without_entities(surface, F.col("text_clean"))
    # out of an array of one, else the filter on their number would make the tokens twice
    out = cleaned.select("*", F.explode_outer(F.array(keep_tokens(surface, stop, lemma or (lambda t: F.lower(t))))).alias("tokens"))
    return min_tokens(out, config.min_tokens)


def min_tokens(corpus: DataFrame, least: int) -> DataFrame:
    return corpus.withColumn("n_tokens", F.size("tokens")).where(F.col("n_tokens") >= least)


def terms(frame: DataFrame, column: str, keys: list[str], distinct: bool = False) -> DataFrame:
    """A row per term; distinct: once a document, taken inside the array so that repeats never travel.

    A plain explode would make Spark test the array's size before it, at the scan, and so compute all of it once more.
    """
    return frame.select(*keys, F.explode_outer(F.array_distinct(column) if distinct else F.col(column)).alias("term")).where("term is not null")


def dictionary(frame: DataFrame, column: str, no_below: int, no_above: float) -> DataFrame:
    """term, df of the terms in at least no_below documents and at most the share no_above of them."""
    most = int(frame.count() * no_above)  # one number, so that the filter stays below any join
    df = terms(frame, column, [], True).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.where(F.col("df").between(no_below, most))


def bag_of_words(frame: DataFrame, column: str, vocabulary: DataFrame, key: str = "doc_id") -> DataFrame:
    counts = terms(frame, column, [key]).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return counts.join(vocabulary.select("term"), "term", "left_semi")


#: Words that are counted together where they lie.
_PACK_WORDS = 1 << 21


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, docs, tfs of the documents at hand: a term travels once for all of them."""

    def packed(ids: list[pa.Array], lists: list[pa.Array]) -> pa.RecordBatch:
        words = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        rows = np.repeat(np.arange(sum(map(len, ids))), np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists]))
        key = np.sort(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32 | rows)
        key, tf = np.unique(key, return_counts=True)
        cuts = pa.array(np.searchsorted(key >> 32, np.arange(len(words.dictionary) + 1)), pa.int32())
        docs = pa.concat_arrays(ids).take(pa.array(key & 0xFFFFFFFF))
        return pa.RecordBatch.from_arrays([words.dictionary, pa.ListArray.from_arrays(cuts, docs), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int32()))], names=["term", "docs", "tfs"])

    ids, lists, held = [], [], 0
    for batch in batches:
        at, offsets = 0, batch.column(1).offsets.to_numpy()
        while at < batch.num_rows:
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PACK_WORDS - held, "right")) - 1))
            ids.append(batch.column(0).slice(at, to - at)), lists.append(batch.column(1).slice(at, to - at))
            held, at = held + int(offsets[to] - offsets[at]), to
            if held >= _PACK_WORDS or at < batch.num_rows:
                yield packed(ids, lists)
                ids, lists, held = [], [], 0
    if ids:
        yield packed(ids, lists)


def bag_of_held_words(frame: DataFrame, column: str, no_below: int, no_above: float, key: str = "doc_id") -> DataFrame:
    """key, term, tf of the terms of dictionary(): bag_of_words() with one exchange, in which a term goes once for many documents.

    Terms have a row for each pack of documents, so a word of most documents is no large group.
    """
    most = int(frame.count() * no_above)
    schema = f"term string, docs array<{frame.schema[key].dataType.simpleString()}>, tfs array<int>"
    packs = frame.select(key, F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("terms")).mapInArrow(_packed, schema)
    df = F.sum(F.size("docs")).over(Window.partitionBy("term"))
    held = packs.withColumn("df", df).where(F.col("df").between(no_below, most))
    rows = held.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("x")).select(F.col("x.docs").alias(key), "term", F.col("x.tfs").alias("tf"))
    return rows.groupBy(key, "term").agg(F.sum("tf").alias("tf"))  # rows with one key


def document_frequency(frame: DataFrame, column: str, k: int = 50) -> DataFrame:
    """The k most frequent terms by documents, with their share rounded to three places."""
    total = frame.agg(F.count(F.lit(1)).alias("total"))
    df = terms(frame, column, [], True).groupBy("term").agg(F.count(F.lit(1)).alias("n_docs")).orderBy(F.desc("n_docs"), "term").limit(k)
    return df.crossJoin(F.broadcast(total)).select("term", "n_docs", F.round(F.col("n_docs") / F.col("total"), 3).alias("part_docs"))  # one row


def top_terms(frame: DataFrame, column: str, by: str = "label", k: int = 30) -> DataFrame:
    counts = terms(frame, column, [by]).groupBy(by, "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "term"))).where(F.col("rank") <= k)


def term_share_gap(frame: DataFrame, column: str, k: int = 20) -> DataFrame:
    """Shares of documents of either label that hold a term, and their gap; the k terms at both ends. One pass, no outer join."""
    sizes = frame.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    counts = terms(frame, column, ["label"], True).groupBy("term").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
    shares = counts.crossJoin(F.broadcast(sizes)).select("term", F.coalesce(F.try_divide("c0", "n0"), F.lit(0.0)).alias("neg"), F.coalesce(F.try_divide("c1", "n1"), F.lit(0.0)).alias("pos"))
    gaps = shares.withColumn("ecart", F.round(F.col("pos") - F.col("neg"), 9))
    return gaps.orderBy("ecart", "term").limit(k).withColumn("side", F.lit("neg")).unionByName(gaps.orderBy(F.desc("ecart"), "term").limit(k).withColumn("side", F.lit("pos")))


def noise_profile(frame: DataFrame, column: str) -> DataFrame:
    """motif, n, part of each kind of noise, from one pass over the texts."""
    found = frame.select(*(F.col(column).rlike(unicode_classes(p)).cast("long").alias(k) for k, p in NOISE.items()))
    sums = found.agg(F.count(F.lit(1)).alias("_total"), *(F.sum(k).alias(k) for k in NOISE))
    return sums.unpivot("_total", list(NOISE), "motif", "n").select("motif", "n", (F.col("n") / F.col("_total")).alias("part")).orderBy(F.desc("part"), "motif")


def match_contexts(frame: DataFrame, column: str, pattern: str, k: int = 3, key: str = "doc_id") -> DataFrame:
    """The first k documents that match, with the match and 40 characters on both sides."""
    return frame.where(F.col(column).rlike(pattern)).orderBy(key).limit(k).select(key, match_context(F.col(column), pattern).alias("context"))


def label_distribution(frame: DataFrame) -> DataFrame:
    counts = frame.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def length_describe(frame: DataFrame, column: str, by: str = "label") -> DataFrame:
    """count, mean, std, min, quartiles (exact, interpolated) and max of characters and words, in long form."""
    sized = frame.select(by, F.length(column).cast("double").alias("n_chars"), word_count(F.col(column)).cast("double").alias("n_words"))
    long = sized.unpivot(by, ["n_chars", "n_words"], "measure", "x")
    quartile = lambda q: F.percentile("x", q)
    return long.groupBy(by, "measure").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), quartile(0.25).alias("q25"), quartile(0.5).alias("q50"), quartile(0.75).alias("q75"), F.max("x").alias("max")
    )


def share_where(frame: DataFrame, predicate: Column, out: str = "share") -> DataFrame:
    return frame.agg(F.avg(predicate.cast("double")).alias(out))


def length_histogram(frame: DataFrame, column: str, bins: int = 60, by: str = "label") -> DataFrame:
    """Words per document in `bins` equal bins from 0 to the longest; the longest belongs to the last bin."""
    sized = frame.select(by, word_count(F.col(column)).alias("n_words"))
    most = sized.agg(F.greatest(F.max("n_words"), F.lit(1)).alias("most"))
    placed = sized.crossJoin(F.broadcast(most)).withColumn("bin", F.least(F.floor(F.col("n_words") * bins / F.col("most")), F.lit(bins - 1)).cast("int"))
    return placed.groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"))


def default_tokens(frame: DataFrame, column: str = "text") -> DataFrame:
    return frame.withColumn("tokens", tokens(F.col(column)))


def name_runs(c: Column) -> Column:
    """Runs of two or more capitalised words: a plain stand-in for an entity recogniser."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), F.lit(1))


def entity_frequency(frame: DataFrame, column: str, k: int = 30, extract: Callable[[Column], Column] = name_runs) -> DataFrame:
    """The k most frequent entities, with the number of mentions."""
    return frame.select(F.explode_outer(extract(F.col(column))).alias("entity")).where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def without_entities(tokens_: Column, text: Column, extract: Callable[[Column], Column] = name_runs) -> Column:
    """Tokens that are not part of an entity of the text."""
    words = F.flatten(F.transform(extract(text), lambda e: F.split(F.lower(e), " ")))
    # bound to a name by an array of one, else it is computed for every token
    return F.get(F.transform(F.array(words), lambda w: F.filter(tokens_, lambda t: ~F.array_contains(w, F.lower(t)))), F.lit(0))
