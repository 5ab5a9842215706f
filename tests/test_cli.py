"""Every stage of the command line over a small corpus, and the settings that change it."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark import cli
from quillspark.sources import io


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs.join(labels, "doc_id").where("text is not null").select("doc_id", F.col("text").alias("review"), F.col("quality").alias("label")).write.parquet(str(folder / "input"))
    (folder / "settings.yaml").write_text("reduction: pca\nclustering: kmeans\nclusters: 6\ntopics: 5\nk_grid: [2, 3]\npasses: 2\nno_below: 2\nmin_words: 3\n")
    return folder


def run(root, stage, *more):
    cli.main([stage, "--root", str(root / "work"), "--input", str(root / "input"), "--config", str(root / "settings.yaml"), *more])


def test_all_stages(spark, root, capsys):
    for stage in ("data", "preprocess", "embed", "train", "sentiment", "lda", "evaluate", "label", "export"):
        run(root, stage)
    made = {p.name for p in (root / "work" / "artifacts").iterdir()}
    assert {"topics", "centroids", "reviews", "representative_reviews", "topic_distances", "summary.json", "CARD.md"} <= made
    summary = io.read_document(spark, f"{root}/work/artifacts/summary.json")
    models = {r["model"] for r in summary["comparison"]}
    assert "topics" in models and 2 <= len(models) <= 3 and all(r["fit_seconds"] is not None for r in summary["comparison"])
    assert summary["run"]["n_topics"] == summary["n_topics"] > 1
    run(root, "lda", "--k", "3")  # an old grid is read while it is replaced
    assert spark.read.parquet(f"{root}/work/lda_grid").groupBy("k").count().where("count > 1").isEmpty()
    capsys.readouterr()
    run(root, "publish", "--dry-run")
    assert "topics" in capsys.readouterr().out and not (root / "work" / "published").exists()
    run(root, "publish")
    assert (root / "work" / "published" / "CARD.md").exists()
    text = spark.read.parquet(f"{root}/work/corpus").orderBy("doc_id").first()
    capsys.readouterr()
    run(root, "predict", "--text", text.review, "too short")
    first, second, last = map(json.loads, capsys.readouterr().out.strip().splitlines()[-3:])
    assert first["enough"] and first["similar"][0]["doc_id"] == text.doc_id and first["similar"][0]["similarity"] > 0.999 and len(first["topics"]) == 3
    assert not second["enough"] and "topics" not in second and last["seconds"] > 0


def test_density_topics(spark, root):
    run(root, "train", "--tag", "dense", "--clustering", "density", "--reduction", "graph", "--min-cluster-size", "4", "--selection", "leaf", "--no-save")
    rows = spark.read.parquet(f"{root}/work/topics_dense")
    assert rows.where("topic >= 0").select("topic").distinct().count() > 1
    assert spark.read.parquet(f"{root}/work/runs").where("tag = 'dense'").first().selection == "leaf"
    assert not (root / "work" / "centroids_dense").exists()


def test_labels_by_people(spark, root):
    tag = next(p.name for p in (root / "work").iterdir() if p.name.startswith("labels_clusters") or (p.name.startswith("labels_") and "validation" not in p.name and not p.name.endswith(".json")))
    path = f"{root}/work/{tag}"
    topic = spark.read.parquet(path).agg(F.min("topic")).first()[0]
    given = root / "given.csv"
    given.write_text(f'topic,label,description,kind\n{topic},"Deux mots","Une phrase, deux",ton\n')
    run(root, "label", "--inject", str(given))
    assert spark.read.parquet(path).where(f"topic = {topic}").first().label == "Deux mots"
    given.write_text(f"topic,label,description,kind\n{topic},Un,x,ton\n")
    with pytest.raises(ValueError):
        run(root, "label", "--inject", str(given))


def test_settings_that_change_the_words(spark, root):
    from quillspark.operators import terms

    frame = spark.createDataFrame([(0, ["a", "ab", "abc", "abcd", "z"] * 3), (1, ["x", "xy", "a"])], "topic int, grams array<string>")
    words = lambda **k: {r.topic: r.words for r in terms.topic_info(frame, "grams", 2, **k).collect()}
    assert len(words()[0]) == 2 and words(min_df=2)[0] == ["a"]
    assert words(representation="mmr", diversity=0.9)[0][0] in ("a", "ab", "abc", "abcd", "z") and len(words(representation="mmr")[0]) == 2
