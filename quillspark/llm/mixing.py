"""Mixing sources to target weights: repetition rates per source, whole copies and one hash-seeded Bernoulli copy.

Words are counted once, by expressions, and written as narrow rows. Sums per source are pre-aggregated by (source, salt),
so that a source with a third of all rows is met in SALTS parts; nothing is broadcast on the way to the digest. The draw
of a document is u(seed) = (a + seed * b) mod 2^52 of two numbers from the MD5 of its id: uniform, and independent of
partitions, so that reruns agree. Each source takes the one of SEEDS seeds whose words come nearest to its target, which
matters where a source has few documents or a very long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

#: Weights of the sources in their order, repeating.
CYCLE = (3, 1, 2)
#: Words of the mix as a share of all words, and the most that a source may be repeated.
SHARE, MOST = 1.5, 2.0
SALTS = 32
SEEDS = 16
#: Sources up to which mix() sends its rates to every task; beyond it they are joined by a shuffle.
SENT_SOURCES = 100_000
_BITS = 52
_SOURCE = ["unnamed", "name"]


def count_words(text: Column) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    marks = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]++", "")).cast("long")


def _keys(source: Column, doc_id: Column) -> list[Column]:
    """The source as a flag and a name, so that null is a source of its own and sorts last, and a salt."""
    return [source.isNull().alias("unnamed"), F.coalesce(source.cast("string"), F.lit("")).alias("name"), F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).alias("salt")]


def _draw(doc_id: Column) -> tuple[Column, Column]:
    """Two whole numbers below 2^52 from the MD5 of an id."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")))
    first, second = (F.conv(F.substring(digest, start, 13), 16, 10).cast("long") for start in (1, 14))
    return first.alias("a"), second.alias("b")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, unnamed, name, salt, size and the draw (a, b) of every row."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), *_keys(F.col("source"), doc_id), count_words(F.col("text")).alias("size"), *_draw(doc_id))


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds place, the number of smaller sources: ranges are numbered apart, then shifted by the sizes of those before."""
    ranged = saved(sources.repartitionByRange(*_SOURCE).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shifts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*_SOURCE))
    return ranged.join(shifts, "range").withColumn("place", F.col("shift") + within - 1).drop("range", "shift")


def targets(sources: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds place, weight, target, rate to (unnamed, name, source_size).

    Targets share `share` of all words by weight; none is above `most` times its source. What is above is shared among
    the others by weight until none is above: each turn is one sum over the sources, and only three numbers come back.
    A source without words has target and rate 0.
    """
    weights = F.array(*map(F.lit, cycle))
    table = saved(_ranked(sources).withColumn("weight", F.element_at(weights, (F.col("place") % len(cycle) + 1).cast("int"))), "mix-sources")
    limit = F.lit(float(most)) * F.col("source_size")
    total, free = table.agg(F.sum("source_size"), F.sum("weight")).first()
    left, stopped = share * (total or 0), 0
    while free:
        full = limit <= F.lit(left / free) * F.col("weight")
        count, taken, rest = table.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if count == stopped:
            break
        left, free, stopped = share * total - most * (taken or 0), rest or 0, count
    level = left / free if free else float("inf")
    target = F.when(limit <= F.lit(level) * F.col("weight"), limit).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(free or 1)))
    return table.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _one_more(seed: Column) -> Column:
    """Whether the draw under a seed lies below the fraction of the rate."""
    drawn = (F.col("a") + seed * F.col("b")).bitwiseAND(F.lit((1 << _BITS) - 1))
    return drawn < (F.col("rate") - F.floor("rate")) * float(1 << _BITS)


def rates(rows: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: float = MOST, seeds: int = SEEDS) -> tuple[DataFrame, DataFrame]:
    """Of sizes(): (one row per source: source_size, weight, target, rate, seed; the same per source and salt)."""
    parts = saved(rows.groupBy(*_SOURCE, "salt").agg(F.sum("size").alias("part_size")), "mix-parts")
    known = targets(parts.groupBy(*_SOURCE).agg(F.sum("part_size").alias("source_size")), cycle, share, most)
    salted = parts.join(known, _SOURCE).drop("part_size", "place")
    met = rows.join(salted, [*_SOURCE, "salt"])
    tries = [F.sum(F.when(_one_more(F.lit(s)), F.col("size")).otherwise(0)).alias(f"try{s}") for s in range(seeds)]
    drawn = met.groupBy(*_SOURCE, "salt").agg(*tries).groupBy(*_SOURCE).agg(*(F.sum(f"try{s}").alias(f"try{s}") for s in range(seeds)))
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*(F.struct(F.abs(F.col(f"try{s}") - wanted).alias("gap"), F.lit(s).alias("seed")) for s in range(seeds))))["seed"]
    chosen = saved(known.join(drawn, _SOURCE).select(*_SOURCE, "source_size", "weight", "target", "rate", best.alias("seed")), "mix-rates")
    return chosen, parts.drop("part_size").join(chosen, _SOURCE)


def _copies() -> Column:
    return (F.floor("rate") + F.when(_one_more(F.col("seed")), 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken of every row of docs (doc_id, text, source).

    Null texts have no words; a null source is a source of its own, the last one. Repeated rows of one id are drawn
    alike, as are all rows with a null id. Other columns are left out, so their names cannot clash; an empty table gives none.
    """
    rows = saved(sizes(docs), "mix-sizes")
    _, salted = rates(rows, cycle, share, most, seeds)
    out = rows.join(salted, [*_SOURCE, "salt"]).withColumn("copies", _copies())
    return out.select("doc_id", F.when(~F.col("unnamed"), F.col("name")).alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, most: float = MOST, seeds: int = SEEDS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with all their columns, of any name; texts are not shuffled unless there are very many sources."""
    chosen, salted = rates(saved(sizes(docs), "mix-sizes"), cycle, share, most, seeds)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    doc_id = F.col("row").getField("doc_id").cast("long")
    keyed = row.select("row", *_draw(doc_id), *_keys(F.col("row").getField("source"), doc_id))
    few = chosen.count() <= SENT_SOURCES  # of checked size
    met = keyed.join(F.broadcast(chosen), _SOURCE) if few else keyed.join(salted, [*_SOURCE, "salt"])
    return met.select("row", F.explode(F.array_repeat(F.lit(1), _copies())).alias("copy")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
