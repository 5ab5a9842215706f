import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import graph_search


def test_search(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 16))
    x = centres[rng.integers(0, 20, 900)] + 0.6 * rng.normal(size=(900, 16))
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [None] + [1.0] * 15), (None, x[3].tolist()), (1200, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("rank", F.lit(2))
    got = graph_search.search(frame, F.col("vec_id") % 50 == 0, shard_rows=256).toPandas().sort_values(["query_id", "rank"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 900, 50):
        own = got[got.query_id == q]
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in own.vec_id.tolist()
        sims = unit @ unit[q]
        sims[q] = -2
        best = np.lexsort((np.arange(900), -np.round(sims, 12)))[:5]
        hits, total = hits + len({*best} & {*own.vec_id}), total + 5
        assert np.allclose(own.score, [sims[i] for i in own.vec_id], atol=1e-12)
    assert hits / total >= 0.9
    assert got[got.query_id == 100].vec_id.tolist() == [101, 102, 103, 104, 105]
    assert not set(got.query_id) & {1000, 1050, 1100, 1150}


def test_queries_are_not_broadcast(spark):
    """A block of queries is repeated for each shard, so that a broadcast of it would grow with the square."""
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    found = graph_search.search(frame, F.col("vec_id") % 10 == 0, shard_rows=50, block_queries=10)
    got = found.toPandas()
    assert got.groupby("query_id").size().to_dict() == {i: 5 for i in range(0, 200, 10)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_recall_on_the_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.toPandas()
    x = np.array(rows["embedding"].tolist(), np.float64)
    unit, ids = x / np.linalg.norm(x, axis=1, keepdims=True), rows["vec_id"].to_numpy()
    for shard_rows in (1 << 14, 300):
        got = graph_search.search(frame, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).toPandas()
        hits = 0
        for q, own in got.groupby("query_id"):
            sims = unit @ unit[ids == q][0]
            sims[ids == q] = -2
            hits += len({*ids[np.lexsort((ids, -sims))[:5]]} & {*own.vec_id})
        assert got.query_id.nunique() == (ids % 50 == 0).sum() and hits / len(got) >= 0.9


def test_one_large_shard():
    """Hard data, 64 dimensions without structure: recall of a graph of 4,000 nodes."""
    x = graph_search._unit(np.random.default_rng(1).normal(size=(4000, 64)))
    q = x[:200]
    found = graph_search.beam_search(x, graph_search.build_graph(x), graph_search.entry_points(x), q, graph_search.SEARCH_BEAM)
    best = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len({*a} & {*b}) / 5 for a, b in zip(best, found)]) >= 0.9


def test_extreme_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    rows = [(i, (v * 10.0 ** rng.choice([-300, -160, 0, 160, 300])).tolist()) for i, v in enumerate(x)]
    rows += [(7, x[7].tolist()), (7, x[8].tolist()), (50, rows[50][1])]
    got = graph_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got.groupby("query_id").size().to_dict() == {0: 5, 50: 5} and got.score.notna().all()
    for r in got.itertuples():
        assert r.query_id != r.vec_id
        assert abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 or (r.vec_id == 7 and abs(r.score - unit[r.query_id] @ unit[8]) < 1e-12)


def test_one_vector(spark):
    assert graph_search.search(spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_no_vectors(spark):
    assert graph_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_nodes_are_pruned_together():
    """All nodes of a block at once: the same neighbours as by the rule, one node and candidate after the other."""
    rng = np.random.default_rng(3)
    x = graph_search._unit(rng.normal(size=(400, 6)))
    nodes = np.arange(0, 400, 2)
    pools = graph_search._distinct(rng.integers(-1, 400, (200, 60)), nodes)
    assert not (pools == nodes[:, None]).any()
    for relax in (1.0, 1.2):
        got = graph_search.robust_prune(x, nodes, pools, 7, relax)
        for node, pool, own in zip(nodes, pools, got):
            pool, kept = pool[pool >= 0], []
            far = lambda a, b: np.maximum(2 - 2 * (x[a] * x[b]).sum(), 0)
            for c in sorted(pool, key=lambda c: far(c, node)):
                if len(kept) < 7 and all(relax * relax * far(c, k) > far(c, node) for k in kept):
                    kept.append(c)
            assert own[own >= 0].tolist() == kept
