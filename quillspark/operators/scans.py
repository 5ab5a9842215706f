"""Numbers and running values over keys of any size: ranges or blocks are worked on apart, then shifted by those before them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.io import kept

#: Places that are summed in one piece.
BLOCK = 1 << 16


def numbered(frame: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds name, the place from 0 on of each row in the whole order (unique), without sorting all rows in one task."""
    ranged = kept(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    shifts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_shift") + within - 1).drop("_range", "_shift")  # a row per range


def _running(frame: DataFrame, key: str, place: str, values: dict[str, str], total: Callable[[str], Column], of_block: Callable[[str], Column], joined: Callable[[Column, Column], Column], backwards: bool, own: bool, block: int) -> DataFrame:
    ordered = F.desc if backwards else F.asc
    rows = frame.withColumn("_block", F.floor(F.col(place) / block))
    within = Window.partitionBy(key, "_block").orderBy(ordered(place)).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(key).orderBy(ordered("_block")).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(key, "_block").agg(*(of_block(v).alias(n) for n, v in values.items()))
    shifts = ends.select(key, "_block", *(total(n).over(before).alias(f"_before_{n}") for n in values))
    out = rows.withColumns({n: total(v).over(within) for n, v in values.items()}).join(shifts, [key, "_block"], "left")
    return out.withColumns({n: joined(F.col(n), F.col(f"_before_{n}")) for n in values}).drop("_block", *(f"_before_{n}" for n in values))


def running_sums(frame: DataFrame, key: str, place: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds sums (new name: column) of each key by place (a whole number), the row's own included."""
    return _running(frame, key, place, values, F.sum, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)), False, True, block)


def next_known(frame: DataFrame, key: str, place: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds the value (new name: column) of the next greater place of the key where it is not null."""
    return _running(frame, key, place, values, lambda c: F.last(c, ignorenulls=True), lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(place))), F.coalesce, True, False, block)
