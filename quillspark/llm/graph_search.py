"""Approximate nearest neighbours by cosine over robust-pruned directed graphs, one per shard of the vectors.

Every vector is indexed. A shard holds a bounded number of vectors, so an index fits in a task; it is built once,
written to the shared folder, and met by the queries in blocks. Equal vectors of a shard are one node of its graph.
Shards are of one size: every query searches every shard, and looks at about a third of its vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

SHARD_ROWS = 8192
#: Components of all vectors of a shard; wider vectors make smaller shards.
SHARD_VALUES = 1 << 24
BLOCK_QUERIES = 8192
MOST_PARTITIONS = 1 << 13
DEGREE = 24
BUILD_BEAM = 40
SEARCH_BEAM = 128
RELAX = 1.2
_AT_ONCE = 3  # nodes of a beam that are expanded in one step
_SIDE_BY_SIDE = 512  # queries that step together
_PRUNE_PAIRS = 1 << 20  # pairs of candidates that are compared at once
_LINKED = 512  # nodes that are linked back together
_DONE, _NONE = np.uint64(1), np.uint64((1 << 64) - 1)
_INDEX = "dim int, shard int, ids binary, places binary, vectors binary, graph binary"


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _keys(far: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of (distance, node); the last bit tells whether the node is expanded."""
    bits = far.astype(np.float32).view(np.uint32)
    rising = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31))
    return (rising.astype(np.uint64) << np.uint64(32)) | (node.astype(np.uint64) << np.uint64(1))


def _node(keys: np.ndarray) -> np.ndarray:
    return ((keys & np.uint64(0xFFFFFFFF)) >> np.uint64(1)).astype(np.int64)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> np.ndarray:
    """Node ids of each query's beam, nearest first, -1 where there are fewer; all queries step side by side."""
    m, n, degree = len(q), len(x), graph.shape[1]
    links = np.where(graph < 0, n, graph)
    keys = np.full((m, beam), _NONE)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True
    start = entry[:beam]
    keys[:, : len(start)] = _keys(-(q @ x[start].T), start)
    keys.sort(axis=1)
    seen[:, start] = True
    live = np.arange(m)
    while len(live):
        # the first few nodes of each beam that are not expanded yet
        own = keys[live]
        todo = (own & _DONE) == 0
        rank = np.cumsum(todo, axis=1)
        pick = todo & (rank <= _AT_ONCE)
        some = pick.any(axis=1)
        live, own, pick, rank = live[some], own[some], pick[some], rank[some]
        if not len(live):
            break
        row, column = np.nonzero(pick)
        near = links[_node(own[row, column])]
        own[row, column] |= _DONE
        keys[live] = own
        at, link = np.nonzero(~seen[live[row][:, None], near])
        who, node = live[row[at]], near[at, link]
        seen[who, node] = True
        more = np.full((len(live), _AT_ONCE * degree), _NONE)
        more[row[at], (rank[row, column][at] - 1) * degree + link] = _keys(-np.einsum("ij,ij->i", q[who], x[node]), node)
        both = np.concatenate([own, more], axis=1)
        both.sort(axis=1)
        np.copyto(both[:, 1:], _NONE, where=both[:, 1:] == both[:, :-1])  # a node that two expansions share counts once
        keys[live] = both[:, :beam]
    keys.sort(axis=1)
    return np.where(keys == _NONE, -1, _node(keys)).astype(np.int32)


def _distinct(pools: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Rows of node ids, sorted and padded with -1 at the end, without repeats and the row's own node."""
    last = np.iinfo(pools.dtype).max
    pools = np.sort(np.where((pools < 0) | (pools == own[:, None]), last, pools), axis=1)
    pools[:, 1:][pools[:, 1:] == pools[:, :-1]] = last
    pools.sort(axis=1)
    return np.where(pools == last, -1, pools)


def robust_prune(x: np.ndarray, nodes: np.ndarray, pools: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each node, of its pool (a row of distinct ids, -1 where there are fewer), nearest first, padded with -1.

    A candidate goes if a kept one is nearer to it, by the factor relax, than the node is.
    """
    out, wide = np.full((len(nodes), degree), -1, np.int32), max(1, pools.shape[1])
    for a in range(0, len(nodes), step := max(1, _PRUNE_PAIRS // (wide * wide))):
        pool = pools[a : a + step]
        d = np.maximum(2 - 2 * np.einsum("bpd,bd->bp", x[pool], x[nodes[a : a + step]]), 0)
        d[pool < 0] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
        own = x[pool]
        among = (2 - 2 * (own @ own.transpose(0, 2, 1))) * np.float32(relax * relax)
        alive, number = pool >= 0, np.zeros(len(pool), np.int64)
        for i in range(pool.shape[1]):
            taken = np.flatnonzero(alive[:, i] & (number < degree))
            if len(taken):
                out[a + taken, number[taken]] = pool[taken, i]
                number[taken] += 1
                alive[taken] &= among[taken, i] > d[taken]
    return out


def _link_back(x: np.ndarray, graph: np.ndarray, block: np.ndarray, kept: np.ndarray, degree: int, relax: float) -> None:
    """Adds the node of each row of kept to the neighbours of those it holds, which are pruned where they are too many."""
    row, column = np.nonzero(kept >= 0)
    target, source = kept[row, column], block[row].astype(np.int32)
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    nodes, first, sizes = np.unique(target, return_index=True, return_counts=True)
    by_size = np.argsort(sizes, kind="stable")
    for some in np.array_split(by_size, max(1, -(-len(by_size) // _LINKED))):  # rows of like size lie together
        wide = int(sizes[some].max(initial=0))
        place = np.arange(wide)
        more = np.where(place < sizes[some][:, None], source[np.minimum(first[some][:, None] + place, len(source) - 1)], -1)
        both = _distinct(np.concatenate([graph[nodes[some]], more], axis=1), nodes[some])
        full = (both >= 0).sum(axis=1) > degree
        graph[nodes[some[~full]]] = both[~full][:, :degree]
        graph[nodes[some[full]]] = robust_prune(x, nodes[some[full]], both[full], degree, relax)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> np.ndarray:
    """Neighbours of each row of unit vectors, padded with -1: two passes of searching, pruning and back links."""
    n = len(x)
    graph = np.full((n, degree), -1, np.int32)
    if n <= 1:
        return graph
    rng = np.random.default_rng(17)
    if n - 1 <= degree:
        for i in range(n):
            graph[i, : n - 1] = np.delete(np.arange(n), i)
        return graph
    start = rng.integers(0, n - 1, (n, degree // 2)).astype(np.int32)
    graph[:, : degree // 2] = start + (start >= np.arange(n)[:, None])
    entry = entry_points(x)
    for factor in (1.0, relax):
        order = rng.permutation(n)
        for block in np.array_split(order, max(1, n // 256)):
            pools = beam_search(x, graph, entry, x[block], beam)
            kept = robust_prune(x, block, _distinct(np.concatenate([pools, graph[block]], axis=1), block), degree, factor)
            graph[block] = kept
            _link_back(x, graph, block, kept, degree, factor)
    return graph


def entry_points(x: np.ndarray, number: int = 8) -> np.ndarray:
    """The node nearest to the mean, and others far from those before."""
    centre = x.mean(axis=0)
    chosen = [int((x @ centre).argmax())]
    nearest = x @ x[chosen[0]]
    for _ in range(min(number, len(x)) - 1):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.unique(np.array(chosen, np.int32))


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", kind="stable")
    all_vectors = np.array(frame["embedding"].tolist(), np.float64)
    ids = frame["vec_id"].to_numpy(np.int64)
    packed = np.ascontiguousarray(all_vectors + 0.0).view(np.dtype((np.void, all_vectors.shape[1] * 8))).ravel()
    _, first, node = np.unique(packed, return_index=True, return_inverse=True)
    order = np.lexsort((ids, node))  # by node, then id
    vectors = all_vectors[first]
    graph = build_graph(_unit(vectors))
    row = {"dim": int(frame["dim"].iloc[0]), "shard": int(frame["shard"].iloc[0]), "ids": ids[order].tobytes(), "places": np.searchsorted(node[order], np.arange(len(first) + 1)).astype(np.int64).tobytes(), "vectors": vectors.tobytes(), "graph": graph.tobytes()}
    return pd.DataFrame([row])


def valid_vectors(frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, embedding (doubles), dim of the rows that take part: an id, and a vector with only finite components, not all zero."""
    v = frame.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0)).withColumn("dim", F.size("embedding"))


def shards_for(total: int, dim: int, shard_rows: int = SHARD_ROWS) -> int:
    rows = max(1, min(shard_rows, SHARD_VALUES // max(dim, 1)))
    return max(1, -(-total // rows))


def build_index(vectors: DataFrame, shards: int) -> DataFrame:
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(min(8 * shards, MOST_PARTITIONS), "dim", "shard")  # so that few shards share a task, one after the other
    return saved(dealt.groupBy("dim", "shard").applyInPandas(_build, _INDEX), "graph-index")


def _searcher(k: int, beam: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        row = frame.iloc[0]
        dim = int(row["dim"])
        ids, places = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["places"], np.int64)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1)
        x, out = _unit(vectors), []
        entry = entry_points(x)
        vectors = _scaled(vectors)
        lengths = np.sqrt((vectors * vectors).sum(axis=1))
        blocks = ((np.frombuffer(i, np.int64), np.frombuffer(v, np.float64).reshape(-1, dim)) for i, v in zip(frame["query_ids"], frame["query_vectors"]))
        for q_ids, given in ((i[a : a + _SIDE_BY_SIDE], v[a : a + _SIDE_BY_SIDE]) for i, v in blocks for a in range(0, len(i), _SIDE_BY_SIDE)):
            q = _scaled(given)
            beams = beam_search(x, graph, entry, _unit(given), max(beam, k + 1))
            who, column = np.nonzero(beams >= 0)
            node = beams[who, column]
            # k + 1 ids of a node are enough for the k nearest without the query itself
            sizes = np.minimum(np.diff(places)[node], k + 1)
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = (q[who] * vectors[node]).sum(axis=1) / (np.sqrt((q * q).sum(axis=1))[who] * lengths[node])
            rows = pd.DataFrame({"query_id": np.repeat(q_ids[who], sizes), "vec_id": ids[np.repeat(places[node], sizes) + inside], "score": np.repeat(own, sizes)})
            rows = rows[rows["query_id"] != rows["vec_id"]].drop_duplicates().sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
            out.append(rows.groupby("query_id", sort=False).head(k))
        return pd.concat(out)

    return run


def _pack_queries(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("vec_id", kind="stable").drop_duplicates("vec_id")
    return pd.DataFrame([{"dim": int(frame["dim"].iloc[0]), "block": int(frame["block"].iloc[0]), "query_ids": frame["vec_id"].to_numpy(np.int64).tobytes(), "query_vectors": np.array(frame["embedding"].tolist(), np.float64).tobytes()}])


def search(frame: DataFrame, is_query: F.Column, k: int = 5, beam: int = SEARCH_BEAM, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest that the beams found, of all rows but the query's own, ties to smaller ids.

    Queries are the rows of frame (vec_id, embedding) for which is_query holds. Rows without an id, and vectors that
    are null, zero or hold null or non-finite components, take no part; vectors of other sizes are searched apart. Of
    repeated ids with different vectors each is a candidate, the first by id order is the query. Other columns are left
    out, so their names cannot clash.
    """
    vectors = valid_vectors(frame)
    total, dim = vectors.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = shards_for(total, dim or 1, shard_rows)
    index = build_index(vectors, shards)
    asked = vectors.where(is_query)
    blocks = max(1, -(-asked.count() // block_queries))
    packed = asked.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInPandas(_pack_queries, "dim int, block int, query_ids binary, query_vectors binary")
    place, tasks = ["dim", "shard", "block"], min(8 * shards * blocks, MOST_PARTITIONS)
    # a row of packed becomes one per shard, of which Spark's estimate of its size knows nothing: it is never to be broadcast
    asking = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(tasks, *place)
    asked_of = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *place)
    met = asking.hint("merge").join(asked_of, place)
    found = met.groupBy(*place).applyInPandas(_searcher(k, beam), "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
