"""Conversation prefix trie by heavy-path decomposition.

Only 128-bit hashes and byte lengths of turns travel, never their texts. A prefix is named by its depth and the
exclusive or of hashes of (position, turn), so that prefix names are running sums that blocks of a conversation can make
apart: no conversation, however long, and no node, however many conversations pass it, is held in one task.

Nodes are counted by name. Each node's heavy child is the one with most members; a heavy path runs from a light node (or
the root) down to a leaf and is told by the smallest conversation that ends there. Light nodes above a path halve the
members, so that the paths lie on logarithmically many levels. From the lowest level on, each round suffix-sums along
the path arrays (in blocks, which are then shifted by the blocks behind them) and attaches the totals of its paths to
the parents of their heads; every round is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

#: Positions of a conversation or a path that are summed in one piece.
BLOCK = 1024
SALTS = 32
#: Conversations are grouped by this many, and share up to SHARED - 1 turns of the first of the group.
FAMILY, SHARED = 5, 9
#: Characters of conversation ids that travel as one row.
_CHUNK = 1 << 16
_NODE = ["depth", "k1", "k2"]
_PARENT = ["up", "p1", "p2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, h1, h2, bytes of every row with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    hashes = (F.xxhash64(F.lit(i), F.length("role"), "role", "text").alias(f"h{i}") for i in (1, 2))
    return rows.select("conv_id", "turn", *hashes, F.octet_length("text").cast("long").alias("bytes"))


def numbered(turns: DataFrame) -> DataFrame:
    """Adds pos from 1 on per conversation, by turn (null first), ties by their hashes; ranges are numbered apart."""
    order = [F.asc_nulls_first("turn"), "h1", "h2"]
    ranged = saved(turns.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()), "trie-ranges")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    shifts = counts.select("conv_id", "range", F.sum("n").over(before).alias("shift")).where("shift > 0")  # conversations cut by a border of ranges
    within = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    placed = ranged.withColumn("within", within).join(shifts, ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("within") + F.coalesce("shift", F.lit(0))).cast("long").alias("pos"), "h1", "h2", "bytes")


def family_plan(placed: DataFrame, family: int = FAMILY, shared: int = SHARED) -> DataFrame:
    """conv_id, base, most (turns to take from the base), taken (those it has) and n (turns of its own)."""
    own = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("most"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("has"))
    return convs.join(bases, "base", "left").withColumn("taken", F.least("most", F.coalesce("has", F.lit(0)))).drop("has")


def rebuilt(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, depth, h1, h2, bytes: the first turns of the base, then the conversation's own after as many as were asked for."""
    most = plan.where("taken > 0").select("conv_id", "base", "taken")
    from_base = placed.where(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base").join(most, "base").where("pos <= taken").select("conv_id", F.col("pos").alias("depth"), "h1", "h2", "bytes")
    own = placed.join(plan.select("conv_id", "most", "taken"), "conv_id").where("pos > most").select("conv_id", (F.col("pos") - F.col("most") + F.col("taken")).alias("depth"), "h1", "h2", "bytes")
    return from_base.unionByName(own)


def _blocked(rows: DataFrame, keys: list[str], place: str, values: dict[str, str], xor: bool, backwards: bool, block: int) -> DataFrame:
    """rows with running totals (new name: column) per keys by place; blocks are summed apart and shifted by those before (or behind) them."""
    total = F.bit_xor if xor else F.sum
    ordered = (lambda c: F.desc(c)) if backwards else (lambda c: F.asc(c))
    rows = rows.withColumn("block", F.floor(F.col(place) / block))
    within = Window.partitionBy(*keys, "block").orderBy(ordered(place)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(ordered("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*keys, "block").agg(*(total(v).alias(n) for n, v in values.items()))
    shifts = blocks.select(*keys, "block", F.row_number().over(Window.partitionBy(*keys).orderBy(ordered("block"))).alias("turn_of"), *(total(n).over(before).alias(f"shift_{n}") for n in values)).where("turn_of > 1").drop("turn_of")
    out = rows.withColumns({n: total(v).over(within) for n, v in values.items()}).join(shifts, [*keys, "block"], "left")
    shift = lambda n: F.coalesce(f"shift_{n}", F.lit(0).cast("long"))
    both = {n: F.col(n).bitwiseXOR(shift(n)) if xor else F.col(n) + shift(n) for n in values}
    return out.withColumns(both).drop("block", *(f"shift_{n}" for n in values))


def chains(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, k1, k2, up, p1, p2, bytes, salt: the node and the parent of each rebuilt turn."""
    steps = turns.withColumns({f"z{i}": F.xxhash64(F.lit(i), "depth", "h1", "h2") for i in (1, 2)}).drop("h1", "h2")
    named = _blocked(steps, ["conv_id"], "depth", {"k1": "z1", "k2": "z2"}, True, False, block)
    parent = (F.col(f"k{i}").bitwiseXOR(F.col(f"z{i}")).alias(f"p{i}") for i in (1, 2))
    return named.select("conv_id", *_NODE, (F.col("depth") - 1).alias("up"), *parent, "bytes", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt"))


def _as_node(frame: DataFrame) -> DataFrame:
    """Rows about a parent as rows about a node."""
    return frame.withColumnsRenamed(dict(zip(_PARENT, _NODE)))


class Trie:
    """The tables of a trie, each written once: nodes, kids (of parents), paths, ends."""

    def __init__(self, conversations: DataFrame, block: int = BLOCK):
        placed = saved(numbered(turns_of(conversations)), "trie-turns")
        self.plan = saved(family_plan(placed), "trie-plan")
        self.chain = saved(chains(rebuilt(placed, self.plan), block), "trie-chains")
        root = self.plan.agg(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("bytes")).where("n_convs > 0")
        root = root.select("*", F.lit(-1).cast("long").alias("up"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
        # met in SALTS parts, so that a node that a third of all conversations pass can be joined
        self.parts = saved(self.chain.groupBy(*_NODE, *_PARENT, "salt").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes")), "trie-parts")
        whole = self.parts.groupBy(*_NODE, *_PARENT).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"))
        counted = saved(whole.unionByName(root), "trie-counted")
        heaviest = F.max_by(F.struct("k1", "k2"), F.struct("n_convs", -F.col("conv_id"))).alias("heavy")
        kids = saved(_as_node(counted.where("up >= 0").groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("n_children"), heaviest)), "trie-kids")
        heavy = kids.select((F.col("depth") + 1).alias("depth"), F.col("heavy.k1").alias("k1"), F.col("heavy.k2").alias("k2"), F.lit(True).alias("is_heavy"))
        known = counted.join(kids.drop("heavy"), _NODE, "left").join(heavy, _NODE, "left")
        self.nodes = saved(known.withColumns({"n_children": F.coalesce("n_children", F.lit(0)).cast("long"), "is_heavy": F.coalesce("is_heavy", F.lit(False))}), "trie-nodes")
        self.paths = saved(self._paths(), "trie-paths")

    def _paths(self) -> DataFrame:
        """rep, level, node, place on its path (depth), head (the path's light node's depth), own values: one row per node."""
        leaves = self.nodes.where("n_children = 0").select(F.col("conv_id").alias("rep"))
        flags = self.nodes.select(*_NODE, "is_heavy", "n_convs", "bytes", "n_children")
        met = self.chain.drop("bytes").join(leaves.withColumnRenamed("rep", "conv_id"), "conv_id").join(self.parts.select(*_NODE, "salt").join(flags, _NODE), [*_NODE, "salt"])
        value = ((F.col("n_convs") - 1) * F.col("bytes")).alias("value")
        below = met.select(F.col("conv_id").alias("rep"), *_NODE, *_PARENT, "is_heavy", value, (F.col("n_children") == 0).cast("long").alias("leaf"))
        top = self.nodes.where("depth = 0").select(*_NODE, *_PARENT, (F.col("n_children") == 0).cast("long").alias("leaf"))
        # the heavy path of the root belongs to the leaf without light nodes above it
        lights = below.groupBy("rep").agg(F.max(F.when(~F.col("is_heavy"), F.col("depth"))).alias("head"), F.count(F.when(~F.col("is_heavy"), 1)).alias("level"))
        alone = leaves.join(lights, "rep", "left").select("rep", F.coalesce("head", F.lit(0).cast("long")).alias("head"), F.coalesce("level", F.lit(0).cast("long")).alias("level"))
        alone = saved(alone, "trie-heads")
        on_path = below.join(alone, "rep").where("depth >= head").drop("is_heavy")
        rooted = alone.where("level = 0").withColumn("depth", F.lit(0).cast("long")).join(top, "depth").withColumn("value", F.lit(0).cast("long"))
        return on_path.unionByName(rooted)

    def totals(self, block: int = BLOCK) -> DataFrame:
        """node, saved_tokens, n_leaves: sums over subtrees, from the lowest level of paths up."""
        top = self.paths.agg(F.max("level")).first()[0]
        done, hung = [], None
        for level in range(top if top is not None else -1, -1, -1):
            rows = self.paths.where(F.col("level") == level).select("rep", "head", *_NODE, *_PARENT, "value", "leaf")
            if hung is not None:
                rows = rows.join(hung, _NODE, "left").withColumns({"value": F.col("value") + F.coalesce("more_value", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("more_leaf", F.lit(0))}).drop("more_value", "more_leaf")
            summed = saved(_blocked(rows, ["rep"], "depth", {"saved_tokens": "value", "n_leaves": "leaf"}, False, True, block).drop("value", "leaf"), f"trie-level-{level}")
            hung = _as_node(summed.where(F.col("depth") == F.col("head")).groupBy(*_PARENT).agg(F.sum("saved_tokens").alias("more_value"), F.sum("n_leaves").alias("more_leaf")))
            done.append(summed.select(*_NODE, "saved_tokens", "n_leaves"))
        return reduce(DataFrame.unionByName, done) if done else self.nodes.select(*_NODE, F.lit(0).alias("saved_tokens"), F.lit(0).alias("n_leaves")).limit(0)

    def ends(self) -> DataFrame:
        """node, conv_id of every rebuilt conversation, at the node where it ends."""
        length = (F.col("n") - F.least("n", "most") + F.col("taken")).alias("depth")
        last = self.plan.select("conv_id", length)
        below = self.chain.select("conv_id", *_NODE).join(last.where("depth > 0"), ["conv_id", "depth"]).select(*_NODE, "conv_id")
        zero = F.lit(0).cast("long")
        return last.where("depth = 0").select("depth", zero.alias("k1"), zero.alias("k2"), "conv_id").unionByName(below)

    def parents(self) -> DataFrame:
        """node, salt and the smallest member of its parent, for the nodes of each salt."""
        salt = F.pmod(F.xxhash64("k1"), F.lit(SALTS)).alias("salt")
        groups = self.nodes.where("up >= 0").select(*_PARENT, salt).distinct()
        known = self.nodes.select(*(F.col(a).alias(b) for a, b in zip(_NODE, _PARENT)), F.col("conv_id").alias("parent_conv_id"))
        return groups.join(known, _PARENT)


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: of the ids of a node, ascending, joined by commas; they stream through sorted partitions in chunks."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(c, pa.int64()) for c in (*_NODE, "first")] + [("text", pa.string())])
        node, first, held, size = None, 0, [], 0
        for batch in batches:
            out = []
            for *own, conv_id in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id"))):
                if own != node or size > _CHUNK:
                    if node is not None:
                        out.append(dict(zip(_NODE, node), first=first, text=",".join(held)))
                    node, first, held, size = own, conv_id, [], 0
                held.append(str(conv_id))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_NODE, node), first=first, text=",".join(held))], schema=fields)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(c, pa.int64()) for c in _NODE] + [("ends_sha256", pa.string())])
        node, digest = None, None
        for batch in batches:
            out = []
            for *own, text in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "text"))):
                if own != node:
                    if node is not None:
                        out.append(dict(zip(_NODE, node), ends_sha256=digest.hexdigest()))
                    node, digest = own, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_NODE, node), ends_sha256=digest.hexdigest())], schema=fields)

    order = [*_NODE, "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, k1 long, k2 long, first long, text string")
    return packed.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row per node.

    conversations: conv_id, turn, role, text. Turns are ordered by turn, null first, ties by hashes of role and text;
    null roles and texts are empty; rows without a conv_id take no part; repeated rows are turns of their own. Other
    columns are left out, so their names cannot clash; an empty table gives no node, not even a root.
    """
    trie = Trie(conversations, block)
    nodes = trie.nodes.withColumn("salt", F.pmod(F.xxhash64("k1"), F.lit(SALTS)))
    out = nodes.join(trie.totals(block), _NODE).join(ends_digests(trie.ends()), _NODE, "left").join(trie.parents(), [*_PARENT, "salt"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
