"""Stages on the command line: python -m quillspark.cli STAGE --help."""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import Config, load_config
from quillspark.functions.text import ngrams, ngrams_interleaved
from quillspark.operators import artifacts, corpus, density, evaluate, labeling, layout, lda, predict, sentiment, terms, topics
from quillspark.sources import io


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("stage", choices=STAGES)
    parser.add_argument("--root", default="work", help="folder of the stage tables")
    parser.add_argument("--input", help="parquet of review and label, for data")
    parser.add_argument("--config", help="YAML of settings")
    parser.add_argument("--n", type=int, help="sample size")
    parser.add_argument("--tag", help="run to read; default: that of the settings")
    parser.add_argument("--model", help="name of the embedding")
    parser.add_argument("--prefix"), parser.add_argument("--max-seq-length", type=int)
    parser.add_argument("--reduction", choices=["graph", "pca"]), parser.add_argument("--clustering", choices=["density", "kmeans"])
    parser.add_argument("--min-cluster-size", type=int), parser.add_argument("--min-samples", type=int)
    parser.add_argument("--selection", choices=["eom", "leaf"], help="of clusters in the condensed tree")
    parser.add_argument("--clusters", type=int, help="of kmeans"), parser.add_argument("--nr-topics", type=int)
    parser.add_argument("--no-save", action="store_true", help="train: neither centroids nor the map, distances and hierarchy of the topics")
    parser.add_argument("--representation", choices=["ctfidf", "mmr", "keybert"])
    parser.add_argument("--k", type=int, nargs="*", help="topic numbers of the LDA grid"), parser.add_argument("--no-grid", action="store_true", help="lda: only as many topics as the run has")
    parser.add_argument("--force", action="store_true"), parser.add_argument("--agreement", action="store_true")
    parser.add_argument("--inject", help="CSV of topic, label, description, kind that replaces labels, for label")
    parser.add_argument("--text", nargs="*", help="texts, for predict")
    parser.add_argument("--target", help="folder of the published copy, for publish"), parser.add_argument("--dry-run", action="store_true")
    return parser


def settings(args: argparse.Namespace) -> Config:
    base = load_config(args.config) if args.config else Config()
    return base.override(sample_size=args.n, embedding=args.model, prefix=args.prefix, max_length=args.max_seq_length, reduction=args.reduction, clustering=args.clustering, min_cluster_size=args.min_cluster_size, min_samples=args.min_samples, selection=args.selection, clusters=args.clusters, topics=args.nr_topics, representation=args.representation)


class Run:
    """Where the tables of a run lie."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args, self.config, self.root = spark, args, settings(args), args.root.rstrip("/")
        self.tag = args.tag or self.config.run_tag()

    def path(self, name: str, tagged: bool = True) -> str:
        return f"{self.root}/{name}_{self.tag}" if tagged else f"{self.root}/{name}"

    def read(self, name: str, tagged: bool = True) -> DataFrame:
        found = io.current_path(self.spark, self.path(name, tagged))
        if found is None:
            raise FileNotFoundError(f"{self.path(name, tagged)} is missing: run the stage that writes it")
        return self.spark.read.parquet(found)

    def has(self, name: str, tagged: bool = True) -> bool:
        return io.current_path(self.spark, self.path(name, tagged)) is not None

    def save(self, frame: DataFrame, name: str, tagged: bool = True) -> None:
        io.write_parquet(frame, self.path(name, tagged))


def data(run: Run) -> None:
    raw = run.spark.read.parquet(run.args.input)
    raw = raw if "doc_id" in raw.columns else raw.withColumn("doc_id", F.xxhash64("review", "label"))
    run.save(io.load_reviews(raw, n=run.config.sample_size, seed=run.config.seed), "raw", False)


def preprocess(run: Run) -> None:
    run.save(corpus.build_corpus(run.read("raw", False), run.config), "corpus", False)


def embedder(config: Config) -> topics.Embedder:
    """The embedder that the settings name; EMBEDDERS is open for others."""
    if config.embedding not in EMBEDDERS:
        raise ValueError(f"no embedder {config.embedding}: known are {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[config.embedding](config)


def vectors_of(config: Config) -> str:
    """The table of embeddings, named by the embedder's settings alone: runs that only cluster otherwise share it."""
    made = hashlib.sha256(json.dumps(embedder(config).settings(), sort_keys=True).encode()).hexdigest()[:8]
    return f"embeddings_{config.variant()}_n{config.sample_size or 'all'}_{made}"


def embed(run: Run) -> None:
    docs = run.read("corpus", False)
    model = embedder(run.config)
    io.load_or_compute(run.spark, run.path(vectors_of(run.config), False), model.settings(), docs.count(), lambda: model.encode(docs).select("doc_id", "embedding"))


def train(run: Run) -> None:
    c, start = run.config, time.perf_counter()
    docs, vectors = run.read("corpus", False), run.read(vectors_of(c), False)
    reduced = layout.graph_layout(vectors, c.components, c.n_neighbors) if c.reduction == "graph" else topics.reduce_dimensions(vectors, k=c.components)
    if c.clustering == "density":
        raw = density.density_clusters(io.kept(reduced, "reduced"), c.min_cluster_size, c.min_samples, c.selection, c.n_neighbors)
    else:
        raw = topics.cluster(reduced, c.clusters, c.seed, c.outlier_quantile)
    raw = io.kept(raw.withColumn("topic", F.col("topic_raw")), "raw")
    merged = topics.merge_topics(raw, c.topics)
    final = topics.reduce_outliers(merged, c.max_outlier_ratio, c.outlier_threshold)
    run.save(final.select("doc_id", "topic_raw", "topic", "embedding"), "topics")
    grams = docs.select("doc_id", ngrams(F.col("tokens"), c.dedupe_tokens).alias("grams")).join(run.read("topics").select("doc_id", "topic"), "doc_id")
    run.save(terms.topic_info(grams, "grams", c.top_words, c.min_df, c.reduce_frequent_words, c.representation, c.diversity, vectors), "topic_info")
    centres = topics.centroids(run.read("topics"))
    topics.check_centroids(run.read("topics"), centres)
    if not run.args.no_save:
        run.save(centres, "centroids")
        run.save(topics.topic_map(run.read("centroids")), "topic_map")
        run.save(topics.pair_distance(run.read("centroids")), "topic_distances")
        run.save(topics.topic_hierarchy(run.read("centroids")), "topic_hierarchy")
    ratios = {f"outlier_ratio_{k}": f.first()["ratio"] for k, f in (("before", topics.outlier_ratio(run.read("topics"), "topic_raw")), ("after", topics.outlier_ratio(run.read("topics"))))}
    io.write_document(run.spark, run.path("run") + ".json", {"tag": run.tag, "n": c.sample_size, "topics": run.path("topics"), **ratios})
    shown = {"embedding": c.embedding, "reduction": c.reduction, "clustering": c.clustering, "min_cluster_size": c.min_cluster_size, "min_samples": c.min_samples, "selection": c.selection, "clusters": c.clusters, "target_topics": c.topics, "representation": c.representation, "reduce_frequent_words": c.reduce_frequent_words, "dedupe_tokens": c.dedupe_tokens}
    row = {"tag": run.tag, "seq": time.time_ns(), "n_docs": docs.count(), "n_topics": centres.count(), "fit_seconds": time.perf_counter() - start, **ratios, **shown}
    io.append_table(run.spark.createDataFrame([row], RUN_FIELDS), run.path("runs", False))


def _labelled(run: Run) -> DataFrame:
    io.read_document(run.spark, run.path("run") + ".json")
    return run.read("corpus", False).join(run.read("topics"), "doc_id")


def analyse(run: Run) -> None:
    c, docs = run.config, _labelled(run)
    run.save(sentiment.sentiment_table(docs, c.alpha), "topic_sentiment")
    run.save(sentiment.sentiment_table(docs.withColumn("topic", F.col("topic_raw")), c.alpha), "topic_sentiment_raw")
    run.save(terms.class_words(docs.withColumn("grams", ngrams(F.col("tokens"), c.dedupe_tokens)), "grams", c.class_words), "class_words")
    run.save(sentiment.representative_reviews(docs, c.examples).drop("embedding", "tokens"), "representative_reviews")
    run.save(sentiment.sentiment_summary(docs, docs.withColumn("topic", F.col("topic_raw")), c.alpha), "sentiment_summary")


def _streams(run: Run) -> tuple[DataFrame, DataFrame]:
    streams = run.read("corpus", False).select("doc_id", ngrams_interleaved(F.col("tokens")).alias("grams"))
    return streams, corpus.dictionary(streams, "grams", run.config.no_below, run.config.no_above)


def _topic_words(run: Run) -> DataFrame:
    info = run.read("topic_info").where("topic <> -1").select("topic", F.posexplode("words").alias("at", "word"))
    return info.select(F.lit("topics").alias("model"), "topic", (F.col("at") + 1).alias("rank"), "word")


def baseline(run: Run) -> None:
    c = run.config
    streams, vocabulary = _streams(run)
    k_main = run.read("topic_info").where("topic <> -1").count()
    ks = run.args.k or ([k_main] if run.args.no_grid else evaluate.candidate_ks(k_main, c.k_grid))
    run.save(vocabulary, "dictionary", False)
    grid, words = lda.grid_search(streams, run.read("dictionary", False), ks, c.no_below, c.no_above, c.top_words, c.passes, c.seed, models=run.path("lda_models", False))
    # beside the old tables first, which are still read
    for name, new, keys in (("lda_grid", grid, ["k"]), ("lda_words", words, ["model"])):
        io.replace_table(io.upsert(run.read(name, False), new, keys) if run.has(name, False) else new, run.path(name, False))


def compare(run: Run) -> None:
    """The topics, and of the LDA grid the model with as many topics and the one with the best NPMI."""
    c = run.config
    streams, vocabulary = _streams(run)
    vocabulary = run.read("dictionary", False) if run.has("dictionary", False) else vocabulary  # of the stage lda
    runs = io.latest(run.read("runs", False)).where(F.col("tag") == run.tag)
    k_main = run.read("topic_info").where("topic <> -1").count()
    words, fits = evaluate.candidates(_topic_words(run), run.read("lda_words", False), run.read("lda_grid", False), k_main, runs.first()["fit_seconds"])
    run.save(evaluate.per_topic(streams, words, vocabulary, c.coherence_words, c.npmi_window, c.cv_window), "coherence_per_topic")
    table = evaluate.summary(streams, words, vocabulary, c.coherence_words, c.diversity_words, c.npmi_window, c.cv_window)
    run.save(evaluate.compare(table, fits, "topics", "embeddings not included"), "comparison")


def label(run: Run) -> None:
    c = run.config
    if run.args.agreement:
        run.save(labeling.agreement(run.read("labels_validation"), c.agreement_threshold), "labels_agreement")
        return
    given = labeling.inputs(run.read("topic_info"), run.read("representative_reviews"), c.label_keywords, c.examples)
    known = run.read("labels") if run.has("labels") and not run.args.force else None
    if run.args.inject:
        labels = labeling.inject(given, io.read_csv(run.spark, run.args.inject, labeling.LABEL_FIELDS), known)
    else:
        asked = given.withColumn("prompt", labeling.prompt(F.col("keywords"), F.col("reviews"), c.label_chars))
        labels = labeling.resume(LABELERS[c.labeler](c), asked, known)
    io.replace_table(labels, run.path("labels"))
    io.write_document(run.spark, run.path("labels") + ".json", {"tag": run.tag})
    existing = run.read("labels_validation") if run.has("labels_validation") else None
    made = labeling.validation_grid(given, run.read("labels"), existing, run.args.force)
    if made is not existing:
        io.replace_table(made, run.path("labels_validation"))
        io.write_csv(run.read("labels_validation"), run.path("labels_validation_csv"))  # for people to fill


def export(run: Run) -> None:
    docs = _labelled(run)
    artifacts.check_tag(io.read_document(run.spark, run.path("labels") + ".json"), run.tag)
    coherence = run.read("coherence_per_topic").where("model = 'topics'")
    table = artifacts.topic_table(run.read("labels"), run.read("topic_info"), run.read("topic_sentiment"), coherence, run.read("topic_map"))
    last = io.latest(run.read("runs", False)).where(F.col("tag") == run.tag).first()
    summary = {"tag": run.tag, "n_docs": docs.count(), "n_topics": table.count(), "sentiment": run.read("sentiment_summary").first().asDict(), "run": last.asDict()}
    summary["comparison"] = [r.asDict() for r in run.read("comparison").collect()]  # a row per model
    names = run.read("labels").select("topic", F.col("label").alias("name"))
    chart = sentiment.diverging_data(labeling.of_kind(run.read("topic_sentiment"), run.read("labels")), names)
    tables = {"topics": table, "subject_chart": chart, "centroids": run.read("centroids"), "topic_distances": run.read("topic_distances"), "topic_hierarchy": run.read("topic_hierarchy"), "reviews": artifacts.reviews_with_topic(docs.drop("topic"), run.read("topics")), "vectors": run.read("topics").select("doc_id", "topic", "embedding"), "representative_reviews": run.read("representative_reviews")}
    artifacts.export(run.spark, f"{run.root}/artifacts", tables, summary, artifacts.model_card(summary))


def publish(run: Run) -> None:
    """Copies the exported tables to another folder of any store that Spark reaches; a dry run only lists them."""
    for name in artifacts.publish(run.spark, f"{run.root}/artifacts", run.args.target or f"{run.root}/published", run.args.dry_run):
        print(name)


def predict_texts(run: Run) -> None:
    """Nearest topics and documents of given texts, as JSON lines."""
    spark, c = run.spark, run.config
    texts = spark.createDataFrame(list(enumerate(run.args.text or [])), "doc_id long, review string")
    start = time.perf_counter()
    found = predict.predict_texts(texts, run.read("corpus", False), run.read("centroids"), run.read("topics"), embedder(c), c, labels=run.read("labels") if run.has("labels") else None)
    for row in found.orderBy("doc_id").toJSON().collect():
        print(row)
    print(json.dumps({"seconds": round(time.perf_counter() - start, 3)}))


RUN_FIELDS = "tag string, seq long, n_docs long, n_topics long, fit_seconds double, outlier_ratio_before double, outlier_ratio_after double, embedding string, reduction string, clustering string, min_cluster_size int, min_samples int, selection string, clusters int, target_topics int, representation string, reduce_frequent_words boolean, dedupe_tokens boolean"
#: By name in the settings; add to them for others.
EMBEDDERS: dict[str, Callable[[Config], topics.Embedder]] = {"hashing": lambda c: topics.HashingEmbedder(prefix=c.prefix, max_length=c.max_length)}
LABELERS: dict[str, Callable[[Config], labeling.Labeler]] = {"keywords": lambda c: labeling.KeywordLabeler()}
STAGES = {"data": data, "preprocess": preprocess, "embed": embed, "train": train, "sentiment": analyse, "lda": baseline, "evaluate": compare, "label": label, "export": export, "publish": publish, "predict": predict_texts}


def main(argv: list[str] | None = None) -> None:
    args = build_parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"quillspark {args.stage}").getOrCreate()
    STAGES[args.stage](Run(spark, args))


if __name__ == "__main__":
    main()
