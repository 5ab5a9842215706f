"""Topic labels: inputs, prompts, answers, validation by people."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import truncate_words
from quillspark.operators.sentiment import diversified_examples
from quillspark.sources.io import small

KINDS = ("sujet", "ton")
#: What people write in the grid, and the names of the two methods: fixed values.
APPROVED = "validé tel quel"
METHODS = ("approbation", "étiquetage humain indépendant")
LABEL_FIELDS = "topic int, label string, description string, kind string"
#: What is asked of a labeller for one topic.
PROMPT = "Mots-clés du thème :\n{keywords}\n\nTextes représentatifs :\n{reviews}\n\nRépondre en JSON avec label (2 à 4 mots), description (une phrase) et kind (sujet ou ton)."


class Labeler(Protocol):
    """topic, label, description, kind, keywords of a table of labelling inputs."""

    def label(self, inputs: DataFrame) -> DataFrame: ...


class KeywordLabeler:
    """The first words themselves: deterministic, without a network."""

    def label(self, inputs: DataFrame) -> DataFrame:
        first = F.array_join(F.slice("keywords", 1, 3), " ")
        return inputs.select("topic", first.alias("label"), F.concat(F.lit("Textes autour de : "), F.array_join("keywords", ", ")).alias("description"), F.lit("sujet").alias("kind"), "keywords")


def inputs(info: DataFrame, representatives: DataFrame, keywords: int = 10, examples: int = 3, text: str = "review") -> DataFrame:
    """topic, keywords, reviews: the first keywords and a diversified choice of texts."""
    chosen = diversified_examples(representatives, examples)
    texts = chosen.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda s: s[text]).alias("reviews"))
    return small(info.where("topic <> -1").select("topic", F.slice("words", 1, keywords).alias("keywords"))).join(texts, "topic")


def prompt(keywords: Column, reviews: Column, most: int = 600) -> Column:
    shown = F.transform(reviews, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". « "), truncate_words(r, most), F.lit(" »")))
    before, between, after = PROMPT.replace("{reviews}", "{keywords}").split("{keywords}")
    return F.concat(F.lit(before), F.array_join(keywords, ", "), F.lit(between), F.array_join(shown, "\n"), F.lit(after))


def validate(answers: DataFrame) -> DataFrame:
    """Adds label without quotes around it, n_words, valid and error; labels have two to five words."""
    label = F.btrim(F.btrim("label"), F.lit("«»\"' "))
    words = F.size(F.filter(F.split(F.translate(label, "'’", "  "), r"\s+"), lambda w: w != ""))
    out = answers.withColumn("label", label).withColumn("n_words", words)
    error = F.when(~F.coalesce(F.col("n_words").between(2, 5), F.lit(False)), "label").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
    return out.withColumn("valid", error.isNull()).withColumn("error", error)


def of_kind(table: DataFrame, labels: DataFrame, kind: str = KINDS[0]) -> DataFrame:
    """The rows of a table of topics whose label is of a kind; charts show subjects only."""
    return table.join(labels.where(F.col("kind") == kind).select("topic"), "topic", "left_semi")


def missing(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """Topics that have no label yet."""
    return topics.where("topic <> -1").select("topic").distinct().join(labels.select("topic"), "topic", "left_anti").orderBy("topic")


def ask(labeler: Labeler, inputs_: DataFrame, tries: int = 3) -> DataFrame:
    """topic, label, description, kind, keywords, valid, error: invalid answers are asked for again, with what was wrong in column error.

    Topics are few. What is still invalid after the last try stays, marked.
    """
    todo, kept = inputs_.withColumn("error", F.lit(None).cast("string")), None
    for turn in range(tries):
        answers = small(validate(labeler.label(todo)).select("topic", "label", "description", "kind", "keywords", "valid", "error"))
        good = answers if turn == tries - 1 else answers.where("valid")
        kept = good if kept is None else kept.unionByName(good)
        bad = small(answers.where("not valid").select("topic", "error"))
        if turn == tries - 1 or bad.isEmpty():
            break
        todo = inputs_.join(bad, "topic")
    return kept


def resume(labeler: Labeler, inputs_: DataFrame, existing: DataFrame | None, tries: int = 3) -> DataFrame:
    """Existing valid labels, and new ones for the topics without."""
    if existing is None:
        return ask(labeler, inputs_, tries)
    known = existing if "valid" in existing.columns else validate(existing).drop("n_words")
    done = known.where("valid").join(inputs_.select("topic"), "topic", "left_semi")
    todo = inputs_.join(done.select("topic"), "topic", "left_anti")
    return done if todo.isEmpty() else done.unionByName(ask(labeler, todo, tries).select(*done.columns))


def inject(inputs_: DataFrame, given: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Labels given by people, validated, in place of existing ones; a topic that is not there or an invalid label raises."""
    checked = validate(given.select("topic", "label", "description", "kind")).join(inputs_.select("topic", "keywords"), "topic", "left")
    wrong = checked.where("not valid or keywords is null").select("topic", F.coalesce("error", F.lit("topic"))).collect()  # few
    if wrong:
        raise ValueError(f"labels that cannot be used: {[tuple(r) for r in wrong]}")
    own = checked.select("topic", "label", "description", "kind", "keywords", "valid", "error")
    return own if existing is None else own.unionByName(existing.join(own.select("topic"), "topic", "left_anti").select(*own.columns))


def validation_grid(inputs_: DataFrame, labels: DataFrame, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """An empty grid for people to fill; an existing one with any human label stays unless forced."""
    if existing is not None and not force and existing.agg(F.bool_or(F.col("human_label").isNotNull()).alias("filled")).first()["filled"]:
        return existing
    lab = labels.select("topic", F.col("label").alias("llm_label"), F.col("description").alias("llm_description"), F.col("kind").alias("llm_kind"))
    grid = inputs_.join(small(lab), "topic", "left")
    example = F.substring(F.get("reviews", F.lit(0)), 1, 300).alias("example")
    return grid.select("topic", F.array_join("keywords", ", ").alias("keywords"), example, "llm_label", "llm_description", "llm_kind", F.lit(None).cast("string").alias("human_label"), F.lit(None).cast("double").alias("match"))


def agreement(grid: DataFrame, threshold: float = 0.70) -> DataFrame:
    """One row: topics, scored topics, mean match, exact share, method, passed."""
    scored = F.col("match").isNotNull()
    approved = F.trim(F.coalesce("human_label", F.lit(""))) == APPROVED
    out = grid.agg(
        F.count(F.lit(1)).alias("n_topics"), F.count_if(scored).alias("n_scored"), F.avg("match").alias("agreement"),
        F.avg(F.when(scored, (F.col("match") == 1).cast("double"))).alias("exact_share"), F.bool_and(F.when(scored, approved)).alias("all_approved"),
    )
    method = F.when(F.col("all_approved"), METHODS[0]).otherwise(METHODS[1])
    return out.select("n_topics", "n_scored", "agreement", "exact_share", method.alias("method"), (F.col("agreement") >= threshold).alias("passed"))


def agreement_by_kind(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("match").isNotNull()).groupBy("llm_kind").agg(F.round(F.avg("match"), 3).alias("match"))
