"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """Unit length; a zero vector becomes null."""
    # the square is a variable of the outer lambda, so that it is summed once and not for every component
    return F.element_at(F.transform(F.array(dot(v, v)), lambda s: F.when(s > 0, F.transform(v, lambda x: x / F.sqrt(s)))), 1)


def mean_vector(frame: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean per group, one partial sum per dimension and task; dimensions come back in order."""
    parts = frame.select(*keys, F.posexplode(as_doubles(F.col(vector))).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(out))
