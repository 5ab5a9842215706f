"""LDA sharded by term: counts, the bound, topics and priors."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import corpus, sharded_lda


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    topics = np.zeros((3, 60))
    for k in range(3):
        topics[k, 20 * k : 20 * k + 20] = rng.dirichlet(np.full(20, 0.5))
    docs = [([f"w{rng.choice(60, p=topics[t])}" for t in rng.choice(3, 40, p=rng.dirichlet([0.1, 0.1, 0.3]))],) for _ in range(240)]
    docs += [([],), (None,), (["rare"],), (["w1"] * 500,)]
    return spark.createDataFrame(docs, "grams array<string>").repartition(3), topics


def test_counts(spark, planted):
    streams, _ = planted
    counts = sharded_lda.count_cells(streams, 2, 0.5, shard_terms=16, block_docs=100)
    held = {r.term for r in corpus.dictionary(streams.where("grams is not null").withColumn("doc_id", F.monotonically_increasing_id()), "grams", 2, 0.5).collect()}
    assert counts.n_terms == len(held) and counts.n_docs == 244 and counts.parts > 1 and counts.blocks > 1
    total = sum(int(np.frombuffer(r.n, np.int32).sum()) for r in counts.cells.collect())
    assert total == sum(w in held for r in streams.collect() for w in r.grams or [])


def test_bound_never_falls_and_topics_are_found(spark, planted, tmp_path):
    streams, topics = planted
    counts = sharded_lda.count_cells(streams, 2, 0.9, shard_terms=16, block_docs=100)
    model = sharded_lda.fit(counts, 3, 16, seed=1)
    bounds = np.array(model.bounds)
    assert (np.diff(bounds) >= -1e-5 * np.abs(bounds[1:])).all() and bounds[-1] > bounds[1] + 100
    assert model.alpha.max() > 1.3 * model.alpha.min() and model.eta != pytest.approx(1 / 3, abs=1e-3)  # learnt
    words = sharded_lda.topic_words(model, streams, 5, "m").collect()
    groups = {t: {int(r.word[1:]) // 20 for r in words if r.topic == t} for t in range(3)}
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    assert sorted(r["rank"] for r in words if r.topic == 0) == [1, 2, 3, 4, 5]
    sharded_lda.save(model, str(tmp_path / "m"))
    again = sharded_lda.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, sharded_lda.topic_words(again, streams, 5, "m").collect())) == sorted(map(tuple, words))
    plan = sharded_lda._shared_out(counts, counts.docs.select(F.lit("doc").alias("kind"), F.col("block").alias("id"), F.col("ids").alias("weights")), model.totals, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_groups_are_bounded():
    """Six times the driver's 1 GB: a task's group stays small, and the grid is split where least travels."""
    for docs, terms, entries in ((1_230_000, 8_000_000, 700_000_000), (5_000_000, 300_000, 2_000_000_000), (100, 1_000, 0), (0, 0, 0)):
        parts, rows = sharded_lda.grid(docs, terms, entries)
        assert 8 <= parts <= sharded_lda.SLICES and entries <= parts * rows << 25 and docs <= rows * sharded_lda.GROUP_DOCS
        assert all(docs * parts + terms * rows <= docs * p + terms * max(rows, -(-entries // (p << 25))) for p in (8, 16, 64, 256) if p > parts)
    assert sharded_lda.grid(1_230_000, 8_000_000, 0) == (8, 1)


def test_grids_give_the_same_topics(spark, planted, monkeypatch):
    streams, _ = planted
    found = []
    for entries in (1 << 24, 100):
        monkeypatch.setattr(sharded_lda, "GROUP_ENTRIES", entries)
        counts = sharded_lda.count_cells(streams, 2, 0.9, shard_terms=16, block_docs=20)
        found.append((counts.parts * counts.rows, sharded_lda.fit(counts, 3, 4, seed=1).bounds))
    assert found[0][0] == 8 < 20 < found[1][0] and found[0][1] == pytest.approx(found[1][1], rel=1e-5)


def test_thin_cells():
    rng = np.random.default_rng(2)
    values = {"terms": np.sort(rng.choice(1 << 20, 500, False)), "df": rng.integers(1, 4, 500), "doc": rng.integers(0, 1 << 16, 900), "n": rng.integers(1, 3, 900)}
    values = {c: x.astype(sharded_lda._TYPES[c]) for c, x in values.items()}
    thin = next(sharded_lda._thin(iter([pd.DataFrame({c: [x.tobytes(), b""] for c, x in values.items()})])))
    for c, x in values.items():
        assert (sharded_lda._thick(c, thin[c][0]) == x).all() and not len(sharded_lda._thick(c, thin[c][1]))
    assert sum(len(thin[c][0]) for c in values) < 0.6 * sum(x.nbytes for x in values.values())


def test_nothing_to_count(spark):
    streams = spark.createDataFrame([(["a"],), (["b"],)], "grams array<string>")
    model = sharded_lda.fit(sharded_lda.count_cells(streams, 2, 0.9), 2, 2)
    assert sharded_lda.topic_words(model, streams, 5, "m").count() == 0
    assert sharded_lda.count_cells(streams.limit(0), 1, 1.0).n_docs == 0


def test_functions_of_the_gamma():
    x = np.array([1e-3, 0.2, 1.0, 3.7, 12.0, 1e5])
    assert np.allclose(sharded_lda.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)
    h = 1e-4 * x
    slope = (np.array([math.lgamma(v) for v in x + h]) - np.array([math.lgamma(v) for v in x - h])) / (2 * h)
    assert np.allclose(sharded_lda.digamma(x), slope, rtol=1e-5)
    assert np.allclose(sharded_lda.trigamma(x), (sharded_lda.digamma(x + h) - sharded_lda.digamma(x - h)) / (2 * h), rtol=1e-5)


def test_newton_finds_the_priors():
    rng = np.random.default_rng(2)
    draws = rng.dirichlet([0.3, 1.0, 4.0], 20_000)
    assert np.allclose(sharded_lda._dirichlet_step(np.ones(3), np.log(draws).sum(0), len(draws)), [0.3, 1.0, 4.0], rtol=0.05)
    draws = np.maximum(rng.dirichlet(np.full(50, 0.4), 500), 1e-300)
    assert sharded_lda._symmetric_step(1.0, float(np.log(draws).sum()), len(draws), 50) == pytest.approx(0.4, rel=0.05)


def test_counts_stay_where_they_lie_and_bounds_are_those_of_whole_tables(spark, planted):
    streams, _ = planted
    counts = sharded_lda.count_cells(streams, 2, 0.9, shard_terms=16, block_docs=50)
    # a pass sends weights to the groups of cells, which are placed once; their number depends on no product of terms and documents
    placed = counts.cells.repartition(8, "group").persist()
    state = counts.docs.select(F.lit("doc").alias("kind"), F.col("block").alias("id"), F.col("ids").alias("weights"))
    plan = sharded_lda._shared_out(sharded_lda.replace(counts, cells=placed), state, np.ones(3), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("Exchange hashpartitioning(") == 1 and "SortMergeJoin" not in plan
    placed.unpersist()
    assert counts.parts == sharded_lda.PARTS and counts.rows == 1 and counts.drawn == -(-counts.n_terms // 16)

    words = {r.h: r.w for r in streams.select(F.explode("grams").alias("w")).distinct().select("w", F.xxhash64("w").alias("h")).collect()}
    hashes = np.sort(np.concatenate([np.frombuffer(r.hashes, np.int64) for r in counts.shards.collect()]))
    at, docs = {words[h]: i for i, h in enumerate(hashes.tolist())}, [r.grams or [] for r in streams.collect()]
    n = np.zeros((len(docs), len(at)))
    for i, doc in enumerate(docs):
        for w in doc:
            if w in at:
                n[i, at[w]] += 1
    terms = np.zeros((len(at), 3))
    for shard in range(counts.drawn):
        own = np.mod(hashes, counts.drawn) == shard
        terms[own] = np.random.default_rng([5, shard]).gamma(1.0, 1.0, (own.sum(), 3))
    rest, eta, bounds = np.ones((len(docs), 3)), 1 / 3, []
    for _ in range(3):
        a, b = sharded_lda.digamma(rest) - sharded_lda.digamma(rest.sum(1))[:, None], sharded_lda.digamma(terms) - sharded_lda.digamma(terms.sum(0))
        whole = np.exp(a) @ np.exp(b).T
        gamma = sharded_lda.log_gamma
        bound = (n * np.log(whole)).sum() + ((1 / 3 - rest) * a + gamma(rest) - gamma(1 / 3)).sum() + len(rest) * gamma(1.0) - gamma(rest.sum(1)).sum()
        bounds.append(bound + ((eta - terms) * b + gamma(terms) - gamma(eta)).sum() + 3 * gamma(len(terms) * eta) - gamma(terms.sum(0)).sum())
        share = n / whole
        rest, terms = 1 / 3 + np.exp(a) * (share @ np.exp(b)), eta + np.exp(b) * (share.T @ np.exp(a))
    # rows of groups: a bundle of blocks for each
    for counts in (counts, sharded_lda.replace(counts, rows=2, cells=counts.cells.withColumn("group", sharded_lda._group(F.col("slice"), F.col("block"), counts.parts, 2)))):
        assert np.allclose(sharded_lda.fit(counts, 3, 3, seed=5, learn_priors=False).bounds, bounds, rtol=1e-5)
