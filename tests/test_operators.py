"""Operators against hand-made results, and properties that hold for any input."""

import json
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.config import Config, load_config
from quillspark.functions import stats
from quillspark.functions import text as tx
from quillspark.operators import corpus, evaluate, labeling, lda, sentiment, terms, topics
from quillspark.sources import io
from quillspark.streaming.predict import predict_stream


def values(spark, texts, expression):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("o", expression(F.col("t"))).orderBy("i")
    return [r.o for r in frame.collect()]


def test_clean_text(spark):
    given = ["&lt;b&gt;x&lt;/b&gt; y", "a<br\n/>b", "see https://x.y/z now www.a.b", unicodedata.normalize("NFD", "é"), "l’été «ok» “q” `x´", "a  b\x1cc ", "", None]
    assert values(spark, given, tx.clean_text) == ["x y", "a b", "see now", "é", "l'été \"ok\" \"q\" 'x'", "a b c", "", None]


def test_prepare_for_tokens(spark):
    given = ["cœur ŒUVRE æ", "génaaaaial soooo", "noté 8/10 et 12 / 20", "AAaa aab", "18/100"]
    assert values(spark, given, tx.prepare_for_tokens) == ["coeur OeUVRE ae", "génaaial soo", "noté et", "AAaa aab", "18/100"]


def test_truncate_and_counts(spark):
    assert values(spark, ["abc def ghi", "abcdefghijk", "short"], lambda c: tx.truncate_words(c, 9)) == ["abc def […]", "abcdefghi […]", "short"]
    assert values(spark, ["a b c", "", " x "], tx.word_count) == [3, 0, 1]
    assert values(spark, ["x" * 50 + "42" + "y" * 50, "none"], lambda c: tx.match_context(c, "[0-9]+")) == ["x" * 40 + "42" + "y" * 40, None]
    assert values(spark, ["['a', 'b c']"], tx.parse_list) == [["a", "b c"]]
    assert values(spark, ["1234567"], lambda c: tx.french_int(c.cast("long"))) == ["1 234 567"]


def test_ngrams(spark):
    frame = spark.createDataFrame([(["a", "b", "a", "b"],), (["z"],), ([],)], "t array<string>")
    rows = frame.select(tx.ngrams(F.col("t")).alias("n"), tx.ngrams(F.col("t"), True).alias("d"), tx.ngrams_interleaved(F.col("t")).alias("s")).collect()
    assert rows[0].n == ["a", "b", "a", "b", "a b", "b a", "a b"] and rows[0].d == ["a", "b", "a b", "b a"]
    assert rows[0].s == ["a", "a b", "b", "b a", "a", "a b", "b"]
    assert rows[1].n == rows[1].s == ["z"] and rows[2].n == rows[2].s == []


def test_binomial_equals_the_sum():
    for n in (1, 2, 7, 30, 111):
        for p in (0.1, 0.5, 0.73):
            pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
            for k in range(n + 1):
                assert stats.binomial_two_sided(k, n, p) == pytest.approx(min(1, sum(x for x in pmf if x <= pmf[k] * (1 + 1e-7))), rel=1e-8, abs=1e-13)
    assert stats.binomial_two_sided(500_100_000, 1_000_000_000, 0.5) < 1e-9


def test_chi2_tail():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and stats.chi2_tail(0, 3) == 1.0
    assert stats.chi2_tail(9.21034037197618, 2) == pytest.approx(0.01)


def reviews(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t = int(rng.integers(-1, 4))
        v = np.eye(6)[t + 1] + 0.3 * rng.normal(size=6)
        rows.append((i, f"text {i}", int(rng.random() < (0.15 + 0.18 * (t + 1))), t, t if i % 5 else -1, v.tolist()))
    return spark.createDataFrame(rows, "doc_id long, review string, label int, topic int, topic_raw int, embedding array<double>")


def test_sentiment_table(spark):
    docs = reviews(spark)
    rows = sentiment.sentiment_table(docs).collect()
    assert [r.diff_pp for r in rows] == sorted(r.diff_pp for r in rows)
    assert sum(r.n for r in rows) == docs.where("topic <> -1").count()
    for r in rows:
        assert 0 <= r.ci_low <= r.share_pos <= r.ci_high <= 1 and r.q_value >= r.p_value
        assert r.direction == ("neutre" if r.q_value >= 0.05 else "positif" if r.diff_pp > 0 else "négatif")
    same = sentiment.sentiment_table(docs.repartition(7)).collect()
    assert [(r.topic, round(r.p_value, 12)) for r in rows] == [(r.topic, round(r.p_value, 12)) for r in same]


def test_benjamini_hochberg_ties(spark):
    frame = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, 0.9)], "topic int, p double")
    got = {r.topic: r.q for r in stats.benjamini_hochberg(frame, "p", "topic", "q").collect()}
    assert got == pytest.approx({1: 0.04, 2: 0.16 / 3, 3: 0.16 / 3, 4: 0.9})


def test_global_test_with_yates(spark):
    rows = [(i, 0, int(i < 8)) for i in range(10)] + [(i, 1, int(i < 3)) for i in range(10)]
    r = sentiment.global_test(spark.createDataFrame(rows, "doc_id long, topic int, label int")).first()
    assert r.dof == 1 and r.chi2 == pytest.approx(3.2323232323, rel=1e-9) and 0.07 < r.p_value < 0.075


def test_representatives_and_examples(spark):
    reps = sentiment.representative_reviews(reviews(spark), 3)
    assert reps.groupBy("topic", "label").count().where("count > 3").count() == 0 and reps.where("topic = -1").count() == 0
    chosen = sentiment.diversified_examples(reps).collect()
    for t in {r.topic for r in chosen}:
        first = sorted((r.place, r.label) for r in chosen if r.topic == t)[:2]
        assert len({label for _, label in first}) == 2


def test_ctfidf_by_hand(spark):
    frame = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["b", "c"])], "topic int, tokens array<string>")
    got = {(r.topic, r.term): r.score for r in terms.ctfidf(frame, "tokens", ["topic"]).collect()}
    assert got[0, "a"] == pytest.approx(math.sqrt(2 / 3) * math.log(1 + 2 / 2)) and got[1, "b"] == pytest.approx(math.sqrt(1 / 2) * math.log(1 + 2 / 2))


def test_dictionary_and_gap(spark):
    frame = spark.createDataFrame([(0, 0, ["a", "b"]), (1, 1, ["a"]), (2, 1, ["a", "c"])], "doc_id long, label int, tokens array<string>")
    assert {(r.term, r.df) for r in corpus.dictionary(frame, "tokens", 1, 0.5).collect()} == {("b", 1), ("c", 1)}
    gap = {(r.term, r.side): r.ecart for r in corpus.term_share_gap(frame, "tokens").collect()}
    assert gap["b", "neg"] == -1.0 and gap["c", "pos"] == 0.5
    one = corpus.term_share_gap(frame.where("label = 1"), "tokens")
    assert one.count() > 0


def test_npmi_window(spark):
    streams = spark.createDataFrame([(0, ["x", "y", "z", "x"]), (1, ["y", "q"])], "doc_id long, grams array<string>")
    words = spark.createDataFrame([("m", 0, 1, "x"), ("m", 0, 2, "y"), ("m", 0, 3, "nowhere")], "model string, topic int, rank int, word string")
    got = {(r.a, r.b): r.npmi for r in evaluate.pair_npmi(streams, words, 2).collect()}
    # windows: xy, yz, zx, yq: x in 2, y in 3, both in 1
    assert got["x", "y"] == pytest.approx(math.log(0.25 / (0.5 * 0.75)) / -math.log(0.25)) and got["x", "nowhere"] == 0


def test_topics(spark):
    docs = reviews(spark)
    centres = topics.centroids(docs)
    topics.check_centroids(docs, centres)
    near = topics.nearest_topics(docs, centres)
    assert near.join(docs.withColumnRenamed("topic", "t"), "doc_id").where("topic = t").count() > 0.9 * docs.where("topic <> -1").count()
    assert topics.reduce_outliers(docs, 0.99) is docs
    moved = topics.reduce_outliers(docs, 0.0)
    assert moved.count() == docs.count() and moved.where("topic = -1").count() < docs.where("topic = -1").count()
    sizes = [r.n for r in topics.relabel_by_size(docs.withColumn("old", F.col("topic")).drop("topic"), "old").where("topic >= 0").groupBy("topic").agg(F.count("*").alias("n")).orderBy("topic").collect()]
    assert sizes == sorted(sizes, reverse=True)
    assert topics.topic_map(centres).count() == 4
    assert topics.merge_topics(docs, 3).select("topic").distinct().count() == 3


def test_mmr_differs_from_order(spark):
    rows = [(0, "a", [1.0, 0.0]), (0, "b", [0.999, 0.0447]), (0, "c", [0.6, 0.8])]
    frame = spark.createDataFrame([(t, w, v, [0.98, 0.2]) for t, w, v in rows], "topic int, word string, embedding array<double>, topic_embedding array<double>")
    got = [r.word for r in terms.maximal_marginal_relevance(frame, 2, 0.7).orderBy("rank").collect()]
    assert got[0] == "b" and got[1] == "c"


def test_labels(spark):
    answers = spark.createDataFrame([(0, "« Films d'horreur »", "d", "sujet"), (1, "Horreur", "d", "sujet"), (2, "a b c d e f", "d", "ton"), (3, "Deux mots", "d", "x"), (4, None, "d", "ton")], "topic int, label string, description string, kind string")
    got = {r.topic: (r.label, r.valid, r.error) for r in labeling.validate(answers).collect()}
    assert got[0] == ("Films d'horreur", True, None) and got[1][1:] == got[2][1:] == got[4][1:] == (False, "label") and got[3][1:] == (False, "kind")
    inputs = spark.createDataFrame([(0, ["k1", "k2"], ["r1"]), (7, ["k3"], ["r2"])], "topic int, keywords array<string>, reviews array<string>")
    labels = labeling.KeywordLabeler().label(inputs)
    grid = labeling.validation_grid(inputs, labels)
    filled = grid.withColumn("human_label", F.lit("x"))
    assert labeling.validation_grid(inputs, labels, filled) is filled and labeling.validation_grid(inputs, labels, filled, True) is not filled
    assert labeling.resume(labeling.KeywordLabeler(), inputs, labels.where("topic = 0")).count() == 2


def test_sources(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    path = str(tmp_path / "cache")
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert io.load_or_compute(spark, path, settings, 5, compute).count() == 5
    assert len(calls) == 2
    frame = spark.createDataFrame([("x", 'a "quoted"\nline, two')], "k string, review string")
    io.write_csv(frame, str(tmp_path / "csv"))
    assert io.read_csv(spark, str(tmp_path / "csv"), frame.schema).first().review == 'a "quoted"\nline, two'
    io.write_document(spark, f"{tmp_path}/d/x.json", {"é": 1})
    assert io.read_document(spark, f"{tmp_path}/d/x.json") == {"é": 1}
    with pytest.raises(FileNotFoundError):
        io.read_document(spark, f"{tmp_path}/none.json")
    assert io.seeded_sample(spark.range(100).withColumnRenamed("id", "doc_id"), 7).count() == 7


def test_config(tmp_path):
    c = Config()
    assert c.override(topics=None, alpha=0.1).alpha == 0.1 and c.alpha == 0.05
    assert c.run_tag() != c.override(prefix="x").run_tag()
    (tmp_path / "c.yaml").write_text(json.dumps({"topics": 12, "k_grid": [3, 4]}))
    assert load_config(str(tmp_path / "c.yaml")).k_grid == (3, 4)


def test_stream(spark, tmp_path):
    docs = reviews(spark, 60).select("doc_id", "embedding", "topic")
    docs.write.parquet(str(tmp_path / "in"))
    centres = topics.centroids(docs)
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = predict_stream(stream, centres).writeStream.format("memory").queryName("predicted").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.doc_id, r.topic) for r in topics.nearest_topics(docs, centres).collect()}
    assert {(r.doc_id, r.topic) for r in spark.table("predicted").collect()} == want


def test_lda_counts_every_term(spark):
    n = (1 << 18) + 1000
    streams = spark.range(4).select(F.transform(F.sequence(F.lit(1), F.when(F.col("id") < 2, n).otherwise(1)), lambda i: F.concat(F.lit("t"), i)).alias("grams"))
    for no_above, terms_ in ((0.5, n - 1), (1.0, n)):
        assert len(lda.vectorise(streams, 2, no_above)[1].vocabulary) == terms_ == corpus.dictionary(streams, "grams", 2, no_above).count()


def test_lda_reads_each_document_once_a_pass(spark):
    streams = spark.range(40).select(F.array_repeat(F.concat(F.lit("t"), "id"), 100).alias("grams"))
    model = lda.fit(lda.vectorise(streams, 1, 1.0)[0], 2, 10)
    seen = model.topicsMatrix().toArray().sum(axis=1)  # of each term: what its one document has added
    assert len(seen) == 40 and seen.min() > 20 and seen.max() - seen.min() < 3


def test_embedding_reads_the_whole_text(spark):
    texts = [["a"] * 600, ["a"] * 600 + ["b"], ["c"]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    got = topics.HashingEmbedder(max_length=Config().max_length).encode(frame).orderBy("doc_id").collect()
    assert got[0].embedding != got[1].embedding


def test_tokens_are_made_once(spark):
    """The filter on the number of tokens reads those that are there."""
    reviews = spark.createDataFrame([(1, "<b>Les chats</b> dorment bien ici", 1), (2, "la", 0), (3, None, 0)], "doc_id long, review string, label int")
    made = corpus.build_corpus(reviews, Config(min_tokens=1))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r.doc_id, r.tokens, r.n_tokens) for r in made.collect()] == [(1, ["chats", "dorment"], 2)]


def test_bag_of_held_words_has_one_exchange(spark, monkeypatch):
    rows = [(i, [f"w{i * j % 7}" for j in range(i % 9)] + ["in all"]) for i in range(60)] + [(3, ["w1", "w1", None]), (61, []), (62, None), (63, ["alone"])]
    frame = spark.createDataFrame(rows, "doc_id long, terms array<string>").repartition(3)
    monkeypatch.setattr(corpus, "_PACK_WORDS", 40)
    got = corpus.bag_of_held_words(frame, "terms", 3, 0.9)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, corpus.bag_of_words(frame, "terms", corpus.dictionary(frame, "terms", 3, 0.9)).select("doc_id", "term", "tf").collect()))
    plan = corpus.bag_of_held_words(frame, "terms", 3, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1 and "Join" not in plan
    assert corpus.bag_of_held_words(frame.limit(0), "terms", 1, 1.0).count() == 0
