"""Graph layout, topic maps and the topic hierarchy."""

import numpy as np
import pytest

from quillspark.operators import layout, topics


def trustworthiness(x, y, k=10):
    n = len(x)
    far = lambda a: ((a[:, None] - a[None]) ** 2).sum(-1)
    rank, near = far(x).argsort(1).argsort(1), far(y).argsort(1)[:, 1 : k + 1]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def test_layout_keeps_neighbours_better_than_components(spark):
    rng = np.random.default_rng(0)
    x = 2 * rng.normal(size=(12, 20))[rng.integers(0, 12, 600)] + rng.normal(size=(600, 20))
    frame = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (600, None)], "doc_id long, embedding array<double>")
    found = layout.graph_layout(frame, 3, 15, "euclidean")
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = {r.doc_id: r.reduced for r in found.collect()}
    assert rows[600] is None
    drawn = np.array([rows[i] for i in range(600)])
    plain = {r.doc_id: r.reduced for r in topics.reduce_dimensions(frame.where("doc_id < 600"), k=3).collect()}
    assert trustworthiness(x, drawn) > trustworthiness(x, np.array([plain[i] for i in range(600)])) + 0.01
    assert np.allclose(drawn.std(0), 1)


def test_leading_vectors_equal_dense_ones(spark):
    rng = np.random.default_rng(4)
    w = np.zeros((60, 60))
    for i in range(60):
        for j in range(i):
            w[i, j] = w[j, i] = rng.uniform() * (1 if i // 15 == j // 15 else 0.02)
    edges = spark.createDataFrame([(j, i, float(w[i, j])) for i in range(60) for j in range(i)], "u long, v long, w double")
    found, values = layout.leading_vectors(edges, 4, rounds=8)
    root = np.sqrt(w.sum(1))
    want, vectors = np.linalg.eigh(w / root[:, None] / root[None])
    assert np.allclose(values, want[::-1][:4], atol=1e-5)
    rows = sorted(found.collect(), key=lambda r: r.u)
    for i in range(4):
        own = np.array([r[f"x{i}"] for r in rows])
        assert abs(abs(own @ vectors[:, -1 - i]) - 1) < 1e-3


def test_memberships(spark):
    near = spark.createDataFrame([(i, j, d) for i in range(3) for j, d in ((10, 0.5), (11, 0.7), (12, 1.5), (13, 4.0))] + [(7, 1, 0.0), (8, 1, 2.0)], "query_id long, key long, distance double")
    rows = layout.memberships(near, 4).collect()
    own = sorted(r.a for r in rows if r.u == 1)
    assert own[-1] == 1.0 and sum(own) == pytest.approx(2.0, abs=1e-6)
    assert [r.a for r in rows if r.u in (7, 8)] == [1.0, 1.0]


def test_map_has_less_stress_than_classical_scaling(spark):
    x = np.random.default_rng(5).normal(size=(14, 12))
    centres = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "topic int, centroid array<double>")
    names, d = topics._distances(centres)
    drawn = np.array([[r.x, r.y] for r in sorted(topics.topic_map(centres).collect())])
    assert topics.stress(d, drawn) < 0.95 * topics.stress(d, topics._classical(d))
    few = {r.topic: (r.x, r.y) for r in topics.topic_map(centres.where("topic < 2")).collect()}
    assert np.hypot(*np.subtract(few[0], few[1])) == pytest.approx(d[0, 1], abs=1e-6)
    assert topics.topic_map(centres.limit(0)).count() == 0 and topics.topic_map(centres.limit(1)).first().x == 0


def greedy(d):
    """Every pair in every turn."""
    groups, out = {i: [i] for i in range(len(d))}, []
    while len(groups) > 1:
        height, a, b = min((round(float(np.mean([d[i, j] for i in groups[a] for j in groups[b]])), 12), a, b) for a in groups for b in groups if a < b)
        new = len(d) + len(out)
        groups[new] = groups.pop(a) + groups.pop(b)
        out.append((a, b, height, len(groups[new])))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    d = rng.integers(1, 5, size=(17, 17)).astype(float) if seed % 2 else rng.uniform(size=(17, 17))  # whole numbers: many ties
    d = np.triu(d, 1) + np.triu(d, 1).T
    assert [(a, b, round(h, 9), n) for a, b, h, n in topics.linkage(d)] == [(a, b, round(h, 9), n) for a, b, h, n in greedy(d)]


def test_hierarchy_table(spark):
    x = np.random.default_rng(1).normal(size=(6, 5))
    centres = spark.createDataFrame([(2 * i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "topic int, centroid array<double>")
    rows = sorted(topics.topic_hierarchy(centres).collect())
    assert [r.parent for r in rows] == [11, 12, 13, 14, 15] and rows[-1]["size"] == 6
    assert {r.a for r in rows} | {r.b for r in rows} == {0, 2, 4, 6, 8, 10, 11, 12, 13, 14}
    assert all(a.height <= b.height for a, b in zip(rows, rows[1:]))
    assert topics.topic_hierarchy(centres.limit(1)).count() == 0
