"""Tables that are published and looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import french_decimal, french_int, word_count
from quillspark.sources.io import now_utc, read_document, small, write_document, write_parquet, write_text


def check_tag(document: dict, tag: str) -> None:
    if document.get("tag") != tag:
        raise ValueError(f"labels belong to {document.get('tag')}, not to {tag}: label the topics again")


def topic_table(labels: DataFrame, info: DataFrame, sentiment: DataFrame, coherence: DataFrame, positions: DataFrame | None = None, top: int = 10) -> DataFrame:
    """A row per labelled topic: label, words with scores, sentiment, coherence (null if unknown), position."""
    words = info.select("topic", F.slice("words", 1, top).alias("words"), F.slice("word_scores", 1, top).alias("word_scores"))
    out = labels.select("topic", "label", "description", "kind").join(small(words), "topic").join(small(sentiment), "topic")
    out = out.join(small(coherence.select("topic", "npmi", "c_v")), "topic", "left")
    return (out if positions is None else out.join(small(positions), "topic", "left")).orderBy("topic")


def reviews_with_topic(corpus: DataFrame, topics: DataFrame) -> DataFrame:
    return corpus.select("doc_id", "review", "label").join(topics.select("doc_id", "topic"), "doc_id")


def intro(table: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: numbers of texts and topics and the mean share, as they are shown."""
    n = reviews.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.col("label").cast("double")).alias("base"))
    t = table.agg(F.count(F.lit(1)).alias("n_topics"), F.count_if("significant").alias("n_significant"))
    return n.crossJoin(t).select(french_int(F.col("n_docs")).alias("n_docs"), "n_topics", "n_significant", french_decimal(100 * F.col("base")).alias("base_percent"))


def short_name(label: F.Column) -> F.Column:
    """A label without its leading phrase, in lower case."""
    return F.lower(F.regexp_replace(label, r"^Critiques (de|d')\s*", ""))


def long_enough(texts: DataFrame, column: str, least: int = 5) -> DataFrame:
    return texts.where(word_count(F.col(column)) >= least)


def export(spark: SparkSession, path: str, tables: dict[str, DataFrame], summary: dict, card: str | None = None) -> None:
    """Writes every table anew, then the summary; parts that do not exist are simply not given."""
    for name, frame in tables.items():
        write_parquet(frame, f"{path}/{name}")
    write_document(spark, f"{path}/summary.json", summary | {"generated_at": now_utc(), "tables": sorted(tables)})
    if card:
        write_text(spark, f"{path}/CARD.md", card)


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame | dict]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names} | {"summary": read_document(spark, f"{path}/summary.json")}


def publish(spark: SparkSession, path: str, target: str, dry_run: bool = False) -> list[str]:
    """Copies the tables of an export and its summary; the names of what is copied. A dry run copies nothing."""
    summary = read_document(spark, f"{path}/summary.json")
    for name in summary["tables"] if not dry_run else ():
        write_parquet(spark.read.parquet(f"{path}/{name}"), f"{target}/{name}")
    if not dry_run:
        write_document(spark, f"{target}/summary.json", summary)
        write_text(spark, f"{target}/CARD.md", model_card(summary))
    return [*summary["tables"], "summary.json", "CARD.md"]


def model_card(summary: dict) -> str:
    count = f"{summary.get('n_docs', 0):,}".replace(",", " ")
    lines = ["# Topic model", "", f"Run `{summary.get('tag', '?')}` over {count} texts, {summary.get('n_topics', 0)} topics.", "", "## Topics and labels", ""]
    lines += [f"- {k}: {v}" for k, v in sorted(summary.get("sentiment", {}).items())]
    lines += ["", "## Settings of the run", ""] + [f"- {k}: {v}" for k, v in sorted(summary.get("run", {}).items())]
    lines += ["", "## Comparison", "", "| model | topics | NPMI | C_V | diversity | coverage | seconds | note |", "|---|---|---|---|---|---|---|---|"]
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines += ["| " + " | ".join(shown(r.get(c)) for c in ("model", "n_topics", "npmi", "c_v", "diversity", "coverage", "fit_seconds", "note")) + " |" for r in summary.get("comparison", [])]
    return "\n".join(lines) + "\n"
