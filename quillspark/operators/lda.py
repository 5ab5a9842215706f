"""LDA baseline: the grid over sharded_lda, and MLlib's own, whose topic prior is fixed and whose model lies in the driver."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import evaluate, sharded_lda
from quillspark.sources.io import kept


def vectorise(streams: DataFrame, no_below: int, no_above: float, column: str = "grams") -> tuple[DataFrame, CountVectorizerModel]:
    """Counts of all terms of corpus.dictionary(streams, column, no_below, no_above), however many."""
    most = no_above if no_above < 1 else float(1 << 62)  # 1.0 would be read as one document
    model = CountVectorizer(inputCol=column, outputCol="counts", minDF=float(no_below), maxDF=most, vocabSize=(1 << 31) - 1).fit(streams)
    return model.transform(streams), model


def shown(model: CountVectorizerModel):
    """The vocabulary where it lies in the JVM, so that only the words asked for come over."""
    return model._java_obj.vocabulary()


def fit(counts: DataFrame, k: int, passes: int = 10, seed: int = 42, online: bool = True) -> LDAModel:
    """Every pass reads each document once. The optimizer is set up in the JVM, as the Python class always samples with replacement."""
    if not online:
        return LDA(k=k, seed=seed, featuresCol="counts", maxIter=max(2, passes), optimizer="em", optimizeDocConcentration=False).fit(counts)
    spark = counts.sparkSession
    ml, mllib = spark._jvm.org.apache.spark.ml.clustering, spark._jvm.org.apache.spark.mllib.clustering
    optimizer = mllib.OnlineLDAOptimizer().setMiniBatchFraction(1.0).setSampleWithReplacement(False).setOptimizeDocConcentration(True)
    cached = counts.is_cached
    kept = counts if cached else counts.select("counts").persist()
    documents = getattr(getattr(ml, "LDA$"), "MODULE$").getOldDataset(kept._jdf, "counts")
    model = mllib.LDA().setK(k).setMaxIterations(passes).setSeed(seed).setOptimizer(optimizer).run(documents)
    if not cached:
        kept.unpersist()
    return LocalLDAModel(ml.LocalLDAModel(f"lda_{k}", model.vocabSize(), model, spark._jsparkSession)).setFeaturesCol("counts").setSeed(seed)


def topic_words(model: LDAModel, vocabulary: Sequence[str], topn: int, name: str) -> DataFrame:
    """model, topic, rank, word by falling probability, ties by term number."""
    described = model.describeTopics(topn)
    words = [(name, r.topic, rank, vocabulary[i]) for r in described.select("topic", "termIndices").collect() for rank, i in enumerate(r.termIndices, 1)]  # k * topn rows
    return described.sparkSession.createDataFrame(words, "model string, topic int, rank int, word string")


def grid_search(streams: DataFrame, vocabulary: DataFrame, ks: list[int], no_below: int, no_above: float, topn: int = 25, passes: int = 10, seed: int = 42, models: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(grid with metrics and seconds, words of all models), sharded by term: counts are packed once for all k.

    With a folder `models`, every model is written there as lda_K; sharded_lda.load() reads it.
    """
    counts = sharded_lda.count_cells(streams, no_below, no_above)
    words, seconds = None, []
    for k in ks:
        start = time.perf_counter()
        model = sharded_lda.fit(counts, k, passes * sharded_lda.STEPS, seed)
        seconds.append((f"LDA (K={k})", k, time.perf_counter() - start))
        if models:
            sharded_lda.save(model, f"{models}/lda_{k}")
        own = sharded_lda.topic_words(model, streams, topn, f"LDA (K={k})")
        words = own if words is None else words.unionByName(own)
    words = kept(words, "lda-words")
    fits = streams.sparkSession.createDataFrame(seconds, "model string, k int, fit_seconds double")
    return evaluate.summary(streams, words, vocabulary).join(F.broadcast(fits), "model").drop("model"), words  # a row per k
