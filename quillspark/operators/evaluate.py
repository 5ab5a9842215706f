"""Coherence, diversity and coverage of ranked topic words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.io import small

EPSILON = 1e-12
#: Windows of a document that are counted at once.
BLOCK = 1 << 14


def restrict(words: DataFrame, vocabulary: DataFrame, topn: int) -> DataFrame:
    """The first topn words of each topic that are in the vocabulary, ranked anew."""
    inside = words.join(vocabulary.select(F.col("term").alias("word")), "word", "left_semi")
    by = Window.partitionBy("model", "topic").orderBy("rank")
    return inside.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= topn).select("model", "topic", "rank", "word")


def coverage(words: DataFrame, vocabulary: DataFrame, topn: int) -> DataFrame:
    """Per model: words of the first topn that are in the vocabulary, over topn times the topics."""
    known = vocabulary.select(F.col("term").alias("word"), F.lit(1).alias("known"))
    marked = words.join(known, "word", "left")
    topics = F.countDistinct("topic")
    return marked.groupBy("model").agg((F.count_if((F.col("rank") <= topn) & F.col("known").isNotNull()) / (topics * topn)).alias("coverage"))


def diversity(words: DataFrame, topn: int) -> DataFrame:
    """Per model: distinct words among the first topn of its topics, over all of them."""
    return words.where(F.col("rank") <= topn).groupBy("model").agg((F.countDistinct("word") / F.count(F.lit(1))).alias("diversity"))


def _count_windows(pairs: list[tuple[int, int]], vocabulary: list[str], window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums over the documents of a task: windows with both words of each pair, with either, and all."""
    left, right = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, both, total = np.zeros(len(vocabulary), np.int64), np.zeros(len(pairs), np.int64), 0
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column(0).drop_null()
            words = pc.index_in(lists.flatten(), value_set=known)
            words = words.fill_null(-1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                windows = max(1, b - a - window + 1)
                total += windows
                at = np.flatnonzero(words[a:b] >= 0)
                if not len(at):
                    continue
                inside, word = np.unique(words[a + at], return_inverse=True)
                place = np.full(len(vocabulary), -1, np.int64)
                place[inside] = np.arange(len(inside))
                here = np.flatnonzero((place[left] >= 0) & (place[right] >= 0))
                for start in range(0, windows, BLOCK):  # windows by their first place, of a very long document in parts
                    size = min(BLOCK, windows - start)
                    low, high = np.clip(at - window + 1 - start, 0, size), np.clip(np.minimum(at, windows - 1) + 1 - start, 0, size)
                    steps = np.zeros((len(inside), size + 1), np.int32)
                    np.add.at(steps, (word, low), 1)
                    np.add.at(steps, (word, high), -1)
                    holds = (np.cumsum(steps[:, :-1], axis=1) > 0).astype(np.float32)
                    met = (holds @ holds.T).astype(np.int64)
                    single[inside] += met.diagonal()
                    both[here] += met[place[left[here]], place[right[here]]]
        columns = [np.arange(len(pairs)), both, single[left], single[right], np.full(len(pairs), total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["pair", "n_ab", "n_a", "n_b", "n_all"])

    return run


def pair_npmi(streams: DataFrame, words: DataFrame, window: int, column: str = "grams", with_self: bool = False) -> DataFrame:
    """model, topic, a, b, npmi of the ordered pairs of words of a topic; with_self: the pairs (a, a) too.

    A document of n tokens has max(1, n - window + 1) windows, all of which count. One pass over the documents counts
    them in place; only sums per pair travel. words is a table of a few words for each topic.
    """
    rows = words.select("model", "topic", "word").distinct().orderBy("model", "topic", "word").collect()  # words per topic times topics
    vocabulary = sorted({r["word"] for r in rows})
    number = {w: i for i, w in enumerate(vocabulary)}
    topics: dict[tuple, list[str]] = {}
    for r in rows:
        topics.setdefault((r["model"], r["topic"]), []).append(r["word"])
    own = [(*t, a, b) for t, inside in topics.items() for i, a in enumerate(inside) for b in inside[i if with_self else i + 1 :]]
    pairs = sorted({(number[a], number[b]) for _, _, a, b in own})
    place = {p: i for i, p in enumerate(pairs)}
    kinds = dict(words.dtypes)
    local = streams.sparkSession.createDataFrame([(*o, place[number[o[2]], number[o[3]]]) for o in own], f"model {kinds['model']}, topic {kinds['topic']}, a string, b string, pair long")
    counted = streams.select(column).mapInArrow(_count_windows(pairs, vocabulary, window), "pair long, n_ab long, n_a long, n_b long, n_all long")
    counted = counted.groupBy("pair").agg(*(F.sum(c).alias(c) for c in ("n_ab", "n_a", "n_b", "n_all")))
    joint = F.col("n_ab") / F.col("n_all")
    product = F.col("n_a") * F.col("n_b") / (F.col("n_all") * F.col("n_all"))
    npmi = F.ln((joint + EPSILON) / product) / -F.ln(joint + EPSILON)
    value = F.when((F.col("n_a") == 0) | (F.col("n_b") == 0), 0.0).otherwise(npmi)
    once = counted.join(F.broadcast(local), "pair").select("model", "topic", "a", "b", value.alias("npmi"))  # as many rows as pairs of words
    turned = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return once.select("model", "topic", F.explode(turned).alias("p"), "npmi").select("model", "topic", "p.a", "p.b", "npmi")


def coherence_npmi(streams: DataFrame, words: DataFrame, window: int = 10, column: str = "grams") -> DataFrame:
    """model, topic, npmi: mean over all ordered pairs; a pair that never meets counts as about -1."""
    return pair_npmi(streams, words, window, column).groupBy("model", "topic").agg(F.avg("npmi").alias("npmi"))


def coherence_cv(streams: DataFrame, words: DataFrame, window: int = 110, column: str = "grams") -> DataFrame:
    """model, topic, c_v: mean cosine of each word's vector of NPMI values with the sum of the topic's vectors."""
    cells = pair_npmi(streams, words, window, column, with_self=True).withColumn("total", F.sum("npmi").over(Window.partitionBy("model", "topic", "b")))
    met = cells.groupBy("model", "topic", "a").agg(F.sum(F.col("npmi") * F.col("total")).alias("ab"), F.sum(F.col("npmi") * F.col("npmi")).alias("aa"), F.sum(F.col("total") * F.col("total")).alias("bb"))
    cosine = F.coalesce(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))), F.lit(0.0))
    return met.groupBy("model", "topic").agg(F.avg(cosine).alias("c_v"))


def per_topic(streams: DataFrame, words: DataFrame, vocabulary: DataFrame, topn: int = 10, npmi_window: int = 10, cv_window: int = 110) -> DataFrame:
    """model, topic, npmi, c_v, words of each topic's words in the vocabulary."""
    kept = small(restrict(words, vocabulary, topn))  # a few words of each topic, used by three metrics
    joined = kept.groupBy("model", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]), ", ").alias("words"))
    return joined.join(coherence_npmi(streams, kept, npmi_window), ["model", "topic"], "left").join(coherence_cv(streams, kept, cv_window), ["model", "topic"], "left").select("model", "topic", "npmi", "c_v", "words")


def summary(streams: DataFrame, words: DataFrame, vocabulary: DataFrame, topn: int = 10, diversity_topn: int = 25, npmi_window: int = 10, cv_window: int = 110) -> DataFrame:
    """model, n_topics, npmi, c_v, diversity, coverage."""
    words = small(words)
    known = small(vocabulary.join(words.select(F.col("word").alias("term")).distinct(), "term", "left_semi"))  # only words of topics
    detail = per_topic(streams, words, known, topn, npmi_window, cv_window).groupBy("model").agg(F.avg("npmi").alias("npmi"), F.avg("c_v").alias("c_v"))
    topics = words.groupBy("model").agg(F.countDistinct("topic").alias("n_topics"))
    return topics.join(detail, "model", "left").join(diversity(words, diversity_topn), "model", "left").join(coverage(words, known, topn), "model", "left").select("model", "n_topics", "npmi", "c_v", "diversity", "coverage")


def compare(summaries: DataFrame, fits: DataFrame, main: str, note: str) -> DataFrame:
    """Summaries with the seconds of each fit, and a note at the main model."""
    return summaries.join(small(fits.select("model", "fit_seconds")), "model", "left").withColumn("note", F.when(F.col("model").startswith(main), note).otherwise(""))


def best_k(grid: DataFrame) -> DataFrame:
    """One row: the first k, by k, with the largest npmi."""
    return grid.agg(F.max_by("k", F.struct("npmi", -F.col("k"))).alias("k"))


def candidates(main: DataFrame, words: DataFrame, grid: DataFrame, k_main: int, main_seconds: float | None = None, name: str = "topics") -> tuple[DataFrame, DataFrame]:
    """(ranked words, seconds) of the models to compare: the main one, of the grid that with as many topics and that with the best NPMI."""
    best = best_k(grid).select(F.lit(False).alias("same"), "k")
    chosen = best.unionByName(grid.where(F.col("k") == k_main).select(F.lit(True).alias("same"), "k")).groupBy("k").agg(F.bool_or("same").alias("same"))
    named = small(grid.join(chosen, "k").select(F.format_string("LDA (K=%d)", "k").alias("model"), "fit_seconds"))  # two rows at most
    fits = named.unionByName(grid.sparkSession.createDataFrame([(name, main_seconds)], "model string, fit_seconds double"))
    return main.unionByName(words.join(named.select("model"), "model", "left_semi").select(*main.columns)), fits


def candidate_ks(k_main: int, grid: tuple[int, ...]) -> list[int]:
    return sorted({k_main, *grid})
