"""Density clusters: mutual reachability over a neighbour graph, its spanning tree, the condensed tree, and a selection.

The edges are numbered by (weight, ends), so that all choices are made by one whole number. In a Boruvka round each
component takes its least edge; edges that are taken inside a component wait until they are lighter than the least edge
that leaves it, and then belong to it. The edges of a component, by weight, are a chain of the single-linkage tree: above
its last edge comes the edge that leaves the component. So the tree of any depth is a logarithmic number of levels of
chains. Sizes run up the chains and the levels, clusters run down; chains are summed in blocks, and every round is
written. Only the condensed tree, at most two clusters per min_cluster_size points, is selected on the driver.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.neighbours import nearest
from quillspark.operators.scans import BLOCK, next_known, numbered, running_sums
from quillspark.operators.topics import OUTLIER, relabel_by_size
from quillspark.sources.io import drop_kept, kept

#: Distances below this count as this, so that densities of copies are finite.
LEAST_DISTANCE = 1e-9
#: Clusters of a condensed tree that the driver takes.
MOST_CLUSTERS = 1 << 20


def mutual_reachability(neighbours: DataFrame, min_samples: int) -> DataFrame:
    """u, v, w (u < v) from query_id, rank, key, distance: the greatest of the distance and both core distances.

    The core distance is that of the min_samples-th neighbour, or of the last one if there are fewer.
    """
    near = neighbours.select(F.col("query_id").alias("u"), "rank", F.col("key").alias("v"), "distance")
    core = near.where(F.col("rank") <= min_samples).groupBy("u").agg(F.max("distance").alias("core"))
    edges = near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "distance").groupBy("u", "v").agg(F.min("distance").alias("distance"))
    other = core.select(F.col("u").alias("v"), F.col("core").alias("core_v"))
    both = edges.join(core, "u").join(other, "v")
    return both.select("u", "v", F.greatest("distance", "core", "core_v", F.lit(LEAST_DISTANCE)).alias("w"))


def _follow(chosen: DataFrame) -> DataFrame:
    """s, next: the end of the pointers (s, p), which lead to a pair that points at itself; the smaller of it is the end."""
    back = chosen.select(F.col("s").alias("p"), F.col("p").alias("back"))
    now = kept(chosen.join(back, "p", "left").select("s", F.when((F.col("back") == F.col("s")) & (F.col("s") < F.col("p")), F.col("s")).otherwise(F.col("p")).alias("next")), "pointers")
    hop = lambda a, b: a.select("s", "next").join(b.select(F.col("s").alias("next"), F.col("next").alias("after")), "next").select("s", F.col("next").alias("passed"), F.col("after").alias("next"))
    while True:
        twice = hop(now, now)
        after = kept(hop(twice, twice).withColumn("moved", F.col("next") != F.col("passed")), "pointers")
        drop_kept(now)
        if not after.where("moved").limit(1).count():
            return after.select("s", "next")
        now = after


class Linkage:
    """Single linkage of edges (u, v, w): chains (level, home, e, w), hangs (level, s, e) of components on edges, and points."""

    def __init__(self, points: DataFrame, edges: DataFrame):
        edges = kept(numbered(edges, ["w", "u", "v"], "e"), "edges")
        weights, live = edges.select("e", "w"), edges.select("e", "u", "v")
        vertices = points.select(F.col("point").alias("s"))
        chains, hangs, waiting = [], [], None
        level = 0
        while True:
            least = live.select(F.col("u").alias("s"), "e", F.col("v").alias("p")).unionByName(live.select(F.col("v").alias("s"), "e", F.col("u").alias("p"))).groupBy("s").agg(F.min("e").alias("e"), F.min_by("p", "e").alias("p"))
            least = kept(least, "least")
            hangs.append(least.select(F.lit(level).alias("level"), "s", "e"))
            if waiting is not None:
                met = waiting.join(least.select(F.col("s").alias("home"), F.col("e").alias("leaving")), "home", "left")
                met = kept(met.withColumn("stays", F.col("leaving").isNull() | (F.col("e") < F.col("leaving"))), "waiting")
                chains.append(met.where("stays").select(F.lit(level).alias("level"), "home", "e"))
                waiting = met.where("not stays").select("e", "home")
            if not live.limit(1).count():
                break
            moved = _follow(least.select("s", "p"))
            taken = least.select("e", "s").join(moved, "s").groupBy("e").agg(F.min("next").alias("home"))
            if waiting is not None:
                up = waiting.join(moved.select(F.col("s").alias("home"), "next"), "home").select("e", F.col("next").alias("home"))
                taken = taken.unionByName(up)
            waiting = kept(taken, "taken")
            for end in ("u", "v"):
                live = live.join(moved.select(F.col("s").alias(end), "next"), end).drop(end).withColumnRenamed("next", end)
            # of parallel edges the least can be taken alone
            crossing = live.where("u <> v").select("e", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            live = kept(crossing.groupBy("u", "v").agg(F.min("e").alias("e")), "live")
            level += 1
        self.levels = level
        self.points = vertices.join(hangs[0].drop("level"), "s", "left").select(F.col("s").alias("point"), "e")
        self.hangs = reduce(DataFrame.unionByName, hangs)
        self.chains = kept(reduce(DataFrame.unionByName, chains).join(weights, "e"), "chains") if chains else None


def condensed(linkage: Linkage, min_cluster_size: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(points: point, cluster, density where it leaves it; clusters: cluster, parent, birth, size).

    A cluster is named by the number of its last edge. A point that never is among min_cluster_size has no cluster.
    """
    one = F.lit(1).cast("long")
    hung = linkage.points.where("e is not null").groupBy("e").agg(F.sum(one).alias("sum"), F.min(one).alias("least"))
    sized = []
    # up: sizes along the chains; what hangs on an edge comes from lower levels
    for level in range(1, linkage.levels + 1):
        rows = linkage.chains.where(F.col("level") == level).join(hung, "e", "left").withColumns({"sum": F.coalesce("sum", F.lit(0)), "least": F.coalesce("least", F.lit(0))})
        done = kept(running_sums(rows, "home", "e", {"size": "sum"}, block), f"sizes-{level}")
        sized.append(done)
        total = done.groupBy("home").agg(F.max("size").alias("total"))
        more = linkage.hangs.where(F.col("level") == level).join(total.withColumnRenamed("home", "s"), "s").groupBy("e").agg(F.sum("total").alias("sum"), F.min("total").alias("least"))
        hung = kept(hung.unionByName(more).groupBy("e").agg(F.sum("sum").alias("sum"), F.min("least").alias("least")), f"hung-{level}")
    # down: the cluster of each large edge, and for small ones the edge at which they fall out
    known, born = None, []
    for level in range(linkage.levels, 0, -1):
        rows = sized[level - 1].withColumn("before", F.col("size") - F.col("sum"))
        smaller = F.when(F.col("before") == 0, F.col("least")).otherwise(F.least("before", "sum"))
        rows = rows.withColumns({"large": F.col("size") >= min_cluster_size, "split": F.when((smaller >= min_cluster_size) & ((F.col("before") > 0) | (F.col("sum") > F.col("least"))), F.struct("e", "w"))})
        leaving = linkage.hangs.where(F.col("level") == level).select(F.col("s").alias("home"), F.col("e").alias("above"))
        homes = rows.groupBy("home").agg(F.max("e").alias("top"), F.max("size").alias("total")).join(leaving, "home", "left")
        if known is None:
            homes = homes.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("up_cluster", "long"), ("up_w", "double"), ("up_splits", "boolean"), ("up_fall_cluster", "long"), ("up_fall_w", "double"))))
        else:
            up = known.select(F.col("e").alias("above"), F.col("cluster").alias("up_cluster"), F.col("w").alias("up_w"), F.col("splits").alias("up_splits"), F.col("fall_cluster").alias("up_fall_cluster"), F.col("fall_w").alias("up_fall_w"))
            homes = homes.join(up, "above", "left")
        starts = (F.col("total") >= min_cluster_size) & (F.col("above").isNull() | F.coalesce("up_splits", F.lit(False)))
        homes = kept(homes.withColumns({"starts": starts, "outer": F.when(starts, F.col("top") * 2 + 1).otherwise(F.col("up_cluster"))}), f"homes-{level}")
        born.append(homes.where("starts").select(F.col("outer").alias("cluster"), F.col("up_cluster").alias("parent"), F.col("above").alias("at"), F.col("up_w").alias("birth"), F.col("total").alias("size")))
        met = next_known(rows, "home", "e", {"splits_above": "split"}, block).join(homes.select("home", "outer", "up_fall_cluster", "up_fall_w"), "home")
        met = kept(met.withColumn("cluster", F.when(F.col("large"), F.coalesce(F.col("splits_above.e") * 2, F.col("outer")))), f"met-{level}")
        lowest = met.where("large").groupBy("home").agg(F.min_by(F.struct("cluster", "w"), "e").alias("low"))
        fall = lambda name, up: F.when(F.col("large"), F.col(name)).otherwise(F.coalesce(F.col("low").getField(name), F.col(up)))
        own = met.join(lowest, "home", "left").select("e", "w", "cluster", F.col("split").isNotNull().alias("splits"), fall("cluster", "up_fall_cluster").alias("fall_cluster"), fall("w", "up_fall_w").alias("fall_w"))
        born.append(met.where("split is not null and before > 0").select((F.col("e") * 2).alias("cluster"), F.col("cluster").alias("parent"), F.col("e").alias("at"), F.col("w").alias("birth"), F.col("before").alias("size")))
        own = kept(own, f"falls-{level}")
        known = own if known is None else known.unionByName(own)
    alone = linkage.points.select("point", F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("double").alias("w"))
    if known is None:
        nothing = linkage.points.select(*(F.lit(None).cast(t).alias(n) for n, t in (("cluster", "long"), ("parent", "long"), ("at", "long"), ("birth", "double"), ("size", "long")))).limit(0)
        return alone, nothing
    falls = known.select("e", F.col("fall_cluster").alias("cluster"), F.col("fall_w").alias("w"))
    points = linkage.points.join(falls, "e", "left").select("point", "cluster", "w")
    return kept(points, "points"), kept(reduce(DataFrame.unionByName, born), "tree")


def condensed_tree(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, parent, at, birth (distance; null: root), size, stability of the tables of condensed().

    Stability is the sum, over the points and clusters that leave a cluster, of their density (1 / distance) above its own at birth.
    """
    left = points.where("cluster is not null").groupBy("cluster").agg(F.sum(1 / F.col("w")).alias("points"))
    below = clusters.where("parent is not null").groupBy(F.col("parent").alias("cluster")).agg(F.sum(F.col("size") / F.col("birth")).alias("below"))
    own = F.when(F.col("birth").isNull(), 0.0).otherwise(F.col("size") / F.col("birth"))
    both = clusters.join(left, "cluster", "left").join(below, "cluster", "left")
    return both.select(*clusters.columns, (F.coalesce("points", F.lit(0.0)) + F.coalesce("below", F.lit(0.0)) - own).alias("stability"))


def select_clusters(tree: DataFrame, selection: str = "eom", most: int = MOST_CLUSTERS) -> DataFrame:
    """cluster, chosen: the selected cluster at or above each cluster of the tree, if any.

    "eom" (excess of mass) takes a cluster if its stability is at least that of the selection below it, "leaf" takes
    those without clusters below. A root that is alone is never taken.
    """
    if selection not in ("eom", "leaf"):
        raise ValueError(f"selection {selection}: known are eom, leaf")
    rows = tree.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} clusters: raise min_cluster_size")
    rows = rows.sort_values(["at", "cluster"], na_position="last").reset_index(drop=True)  # what is below comes first
    place = {c: i for i, c in enumerate(rows["cluster"])}
    up = [place.get(p, -1) if p == p else -1 for p in rows["parent"]]
    below, has_below, taken = np.zeros(len(rows)), np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    roots = sum(u < 0 for u in up)
    for i, stability in enumerate(rows["stability"]):
        allowed = up[i] >= 0 or roots > 1
        taken[i] = allowed and (not has_below[i] if selection == "leaf" else stability >= below[i])
        if up[i] >= 0:
            has_below[up[i]] = True
            below[up[i]] += stability if taken[i] else below[i]
    chosen = np.full(len(rows), -1, np.int64)
    for i in reversed(range(len(rows))):
        above = chosen[up[i]] if up[i] >= 0 else -1
        chosen[i] = above if above >= 0 else rows["cluster"][i] if taken[i] else -1
    pairs = [(int(c), int(t)) for c, t in zip(rows["cluster"], chosen) if t >= 0]
    return tree.sparkSession.createDataFrame(pairs, "cluster long, chosen long")


def density_clusters(frame: DataFrame, min_cluster_size: int, min_samples: int = 1, selection: str = "eom", n_neighbors: int = 15, key: str = "doc_id", vector: str = "reduced", block: int = BLOCK) -> DataFrame:
    """Adds topic_raw, clusters numbered by size, -1 for outliers, to the rows of frame by their vectors' Euclidean distances.

    Each row is joined to its n_neighbors nearest (at least min_samples). What the neighbour graph leaves apart is apart
    at any distance. Rows without a vector are outliers. Keys are whole numbers.
    """
    if min_cluster_size < 2 or min_samples < 1:
        raise ValueError("min_cluster_size is 2 at least, min_samples 1")
    near = nearest(frame, frame, max(n_neighbors, min_samples), key, vector, "euclidean").withColumnRenamed(key, "key")
    points = frame.select(F.col(key).alias("point")).where("point is not null").distinct()
    leaves, clusters = condensed(Linkage(kept(points, "points"), mutual_reachability(kept(near, "near"), min_samples)), min_cluster_size, block)
    chosen = select_clusters(condensed_tree(leaves, clusters), selection)
    labels = leaves.join(chosen, "cluster", "left").select(F.col("point").alias(key), F.coalesce("chosen", F.lit(OUTLIER)).alias("_cluster"))
    labelled = frame.join(kept(labels, "labels"), key, "left").withColumn("_cluster", F.coalesce("_cluster", F.lit(OUTLIER)))
    return relabel_by_size(labelled, "_cluster", "topic_raw", key).drop("_cluster")
