"""Exact neighbours and density clusters against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import density, neighbours

VECTORS = "vec_id long, embedding array<double>"


def frame_of(spark, x, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], VECTORS)


def brute_neighbours(x, q, k, metric="cosine", ids=None, own=None):
    ids = np.arange(len(x)) if ids is None else ids
    out = {}
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    for i, v in enumerate(q):
        far = np.round(np.sqrt(((x - v) ** 2).sum(1)), 10) if metric == "euclidean" else -np.round(unit(x) @ (v / np.linalg.norm(v)), 8)
        order = [j for j in np.lexsort((ids, far)) if own is None or ids[j] != own[i]][:k]
        out[i if own is None else own[i]] = [(int(ids[j]), abs(float(far[j])) if metric == "euclidean" else -float(far[j])) for j in order]
    return out


def as_dict(found, value):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r[value]))
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_neighbours_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "FEW", 10)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(neighbours, "PACK_ROWS", 16)
    monkeypatch.setattr(neighbours, "GROUP_BYTES", 5000)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 6))[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 6))
    x[100:250] = x[100]  # copies
    x[300:310] = x[300] * (1 + 1e-13)
    found = neighbours.nearest(frame_of(spark, x), frame_of(spark, x), 4, metric=metric)
    got = as_dict(found, "similarity" if metric == "cosine" else "distance")
    want = brute_neighbours(x, x, 4, metric, own=np.arange(900))
    assert got.keys() == want.keys()
    for i in want:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]], (i, got[i], want[i])
        assert np.allclose([b for _, b in got[i]], [b for _, b in want[i]], atol=2e-8)


def test_few_queries_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    pool = frame_of(spark, x).unionByName(spark.createDataFrame([(400, None), (401, [0.0] * 5), (402, [None] + [1.0] * 4), (None, [1.0] * 5)], VECTORS)).repartition(5)
    asked = frame_of(spark, x[:30], start=1000)
    got = as_dict(neighbours.nearest(asked, pool, 3), "similarity")
    want = brute_neighbours(x, x[:30], 3)
    assert {i: [a for a, _ in v] for i, v in got.items()} == {1000 + i: [a for a, _ in v] for i, v in want.items()}
    assert neighbours.nearest(asked, pool.limit(0), 3).count() == 0
    assert neighbours.nearest(asked.limit(0), pool, 3).count() == 0


def test_many_queries_without_a_product(spark, monkeypatch):
    """Points in the plane: most blocks are never met."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    seen = []
    meet = neighbours._meet
    monkeypatch.setattr(neighbours, "_meet", lambda pairs, packs, blocks, k: (seen.append((pairs.count(), packs.count(), blocks.count())), meet(pairs, packs, blocks, k))[1])
    x = np.random.default_rng(2).uniform(size=(6000, 2))
    found = neighbours.nearest(frame_of(spark, x), frame_of(spark, x), 3, metric="euclidean")
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert found.count() == 18_000
    assert sum(n for n, _, _ in seen) < 0.25 * seen[0][1] * seen[0][2]


def plain_clusters(x, min_cluster_size, min_samples, selection, k):
    """Single linkage by sorted edges, condensed from the top, selected: {row: cluster number by size} without the outliers."""
    n = len(x)
    near = brute_neighbours(x, x, k, "euclidean", own=np.arange(n))
    core = {i: v[min(min_samples, len(v)) - 1][1] for i, v in near.items()}
    edges = sorted({(max(d, core[i], core[j], density.LEAST_DISTANCE), min(i, j), max(i, j)) for i, v in near.items() for j, d in v})
    home, tree = {i: ("p", i) for i in range(n)}, {}
    size = lambda t: 1 if t[0] == "p" else tree[t][3]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for at, (w, u, v) in enumerate(edges):
        a, b = find(u), find(v)
        if a != b:
            node = ("e", at)
            tree[node] = (home[a], home[b], w, size(home[a]) + size(home[b]))
            root[a] = b
            home[b] = node
    points, clusters, births, parents = {}, [], [], []

    def leaves(t):
        todo, out = [t], []
        while todo:
            t = todo.pop()
            if t[0] == "p":
                out.append(t[1])
            else:
                todo += tree[t][:2]
        return out

    tops = [t for t in {home[find(i)] for i in range(n)} if size(t) >= min_cluster_size]
    todo = []

    def start(t, parent, birth):
        clusters.append(t)
        births.append(birth)
        parents.append(parent)
        todo.append((t, len(clusters) - 1))

    for t in sorted(tops):
        start(t, -1, 0.0)
    stability = {}
    while todo:
        t, c = todo.pop()
        while t is not None:
            a, b, w, _ = tree[t]
            large = [s for s in (a, b) if size(s) >= min_cluster_size]
            for s in (a, b):
                if s not in large:
                    for p in leaves(s):
                        points[p] = (c, 1 / w)
            if len(large) == 2:
                for s in large:
                    start(s, c, 1 / w)
            t = large[0] if len(large) == 1 else None
    for c, t in enumerate(clusters):
        stability[c] = sum(d - births[c] for o, d in points.values() if o == c) + sum(size(clusters[o]) * (births[o] - births[c]) for o in range(len(clusters)) if parents[o] == c)
    taken, score = {}, {}
    for c in reversed(range(len(clusters))):
        kids = [o for o in range(len(clusters)) if parents[o] == c]
        below = sum(score[o] for o in kids)
        allowed = parents[c] >= 0 or len(tops) > 1
        taken[c] = allowed and (not kids if selection == "leaf" else stability[c] >= below - 1e-9)
        score[c] = stability[c] if taken[c] else below
    chosen = {}
    for c in range(len(clusters)):
        chosen[c] = chosen[parents[c]] if parents[c] >= 0 and chosen[parents[c]] is not None else c if taken[c] else None
    groups = {}
    for p, (c, _) in points.items():
        if chosen[c] is not None:
            groups.setdefault(chosen[c], []).append(p)
    order = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
    return {p: i for i, g in enumerate(order) for p in g}


@pytest.fixture(scope="module")
def embeddings(spark):
    rows = sorted(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    return np.array([r.embedding for r in rows], float)


def blobs(seed, spread=0.35):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-4, 4, size=(7, 2))[rng.integers(0, 7, 380)] + spread * rng.normal(size=(380, 2))
    return np.concatenate([x, rng.uniform(-6, 6, size=(60, 2)), np.repeat(x[:1], 30, axis=0)])


@pytest.mark.parametrize(("size", "samples", "selection", "k", "seed"), [(15, 5, "leaf", 15, 0), (8, 3, "eom", 500, 1), (30, 1, "eom", 6, 2)])
def test_clusters_equal_plain_python(spark, size, samples, selection, k, seed):
    x = blobs(seed)
    want = plain_clusters(x, size, samples, selection, min(k, len(x) - 1))
    got = density.density_clusters(frame_of(spark, x), size, samples, selection, k, "vec_id", "embedding", block=64)
    assert {r.vec_id: r.topic_raw for r in got.collect() if r.topic_raw >= 0} == want
    assert len(set(want.values())) > 1


def test_500_embeddings(spark, embeddings):
    want = plain_clusters(embeddings, 5, 1, "eom", 15)
    got = density.density_clusters(frame_of(spark, embeddings), 5, 1, "eom", 15, "vec_id", "embedding")
    assert {r.vec_id: r.topic_raw for r in got.collect() if r.topic_raw >= 0} == want


def test_odd_tables(spark):
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None)], VECTORS)
    assert {r.topic_raw for r in density.density_clusters(odd, 2, key="vec_id", vector="embedding").collect()} == {-1}  # a root alone
    assert density.density_clusters(odd.limit(0), 2, key="vec_id", vector="embedding").count() == 0
    assert [r.topic_raw for r in density.density_clusters(odd.where("vec_id = 1"), 2, key="vec_id", vector="embedding").collect()] == [-1]
    pairs = spark.createDataFrame([(i, [float(i // 3 * 100), 0.0]) for i in range(9)], VECTORS)  # three triples, apart
    got = density.density_clusters(pairs, 3, n_neighbors=2, key="vec_id", vector="embedding")
    assert {r.vec_id: r.topic_raw for r in got.collect()} == {i: i // 3 for i in range(9)}
    with pytest.raises(ValueError):
        density.density_clusters(odd, 1)
    with pytest.raises(ValueError):
        density.select_clusters(odd, "other")


def test_bounded_selection(spark):
    tree = spark.createDataFrame([(1, None, None, None, 9, 1.0), (2, 1, 5, 0.5, 4, 2.0), (3, 1, 5, 0.5, 5, 1.0)], "cluster long, parent long, at long, birth double, size long, stability double")
    assert {tuple(r) for r in density.select_clusters(tree).collect()} == {(2, 2), (3, 3)}
    with pytest.raises(ValueError, match="min_cluster_size"):
        density.select_clusters(tree, most=2)
    assert density.select_clusters(tree.where(F.lit(False))).count() == 0
