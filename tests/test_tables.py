"""Tables that are replaced, logs, grids, labels and grades: small cases by hand."""

import pytest

from quillspark.operators import evaluate, labeling
from quillspark.sources import io


@pytest.mark.parametrize("stopped_at", [0, 1, 2])
def test_a_stopped_replacement_loses_nothing(spark, tmp_path, monkeypatch, stopped_at):
    path = str(tmp_path / "t")
    value = lambda: [r.id for r in spark.read.parquet(io.current_path(spark, path)).collect()]
    assert io.current_path(spark, path) is None
    io.replace_table(spark.range(1, 2), path)
    calls, rename, write = [], io._rename, io.write_parquet

    def stop(*given):
        calls.append(given)
        if len(calls) > stopped_at:
            raise OSError("stopped")
        return (rename if len(given) == 3 else write)(*given)

    monkeypatch.setattr(io, "_rename", stop)
    monkeypatch.setattr(io, "write_parquet", stop)
    with pytest.raises(OSError):
        io.replace_table(spark.range(2, 3), path)
    assert value() == [1] if stopped_at < 2 else value() == [2]  # both lie there whole before the last rename
    monkeypatch.undo()
    last = spark.read.parquet(io.current_path(spark, path))
    assert sorted(r.id for r in io.replace_table(last.union(spark.range(3, 4)), path).collect()) == [1 if stopped_at < 2 else 2, 3]
    assert value() and sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]


def test_grid_and_log(spark):
    grid = lambda rows: spark.createDataFrame(rows, "k int, npmi double, c_v double")
    old = grid([(10, -0.02, 0.41), (15, -0.01, 0.43), (20, -0.01, 0.44), (25, -0.05, 0.40)])
    assert evaluate.best_k(old).first().k == 15
    assert [tuple(r) for r in io.upsert(old, grid([(15, -0.03, 0.42), (30, -0.04, 0.39)]), ["k"]).collect()][1] == (15, -0.03, 0.42)
    runs = spark.createDataFrame([("a", 1, 11.0), ("b", 2, 12.0), ("a", 3, 13.0)], "tag string, seq int, fit_seconds double")
    assert {tuple(r) for r in io.latest(runs).collect()} == {("a", 3, 13.0), ("b", 2, 12.0)}
    assert io.append_run(runs, spark.createDataFrame([("c", 4, 29)], "tag string, seq int, n_topics int")).where("n_topics = 29").first().fit_seconds is None


def test_labels_and_grades(spark):
    answers = [(0, "« Films d'horreur »", "sujet"), (1, "Horreur", "sujet"), (2, '  "Comédies romantiques françaises" ', "ton"), (3, "un deux trois quatre cinq six", "sujet"), (4, "Critiques d’ennui", "autre"), (5, None, "ton")]
    got = {r.topic: (r.label, r.error) for r in labeling.validate(spark.createDataFrame(answers, "topic int, label string, kind string")).collect()}
    assert got[0] == ("Films d'horreur", None) and got[2] == ("Comédies romantiques françaises", None)
    assert [got[i][1] for i in (1, 3, 4, 5)] == ["label", "label", "kind", "label"]
    grades = spark.createDataFrame([(0, "sujet", "validé tel quel", 1.0), (1, "ton", None, 0.5), (2, "sujet", "autre chose", 0.0), (3, "ton", None, None), (4, "sujet", "validé tel quel", 1.0)], "topic int, llm_kind string, human_label string, match double")
    row = labeling.agreement(grades).first()
    assert (row.n_topics, row.n_scored, row.agreement, row.exact_share, row.passed) == (5, 4, 0.625, 0.5, False)
    assert {r.llm_kind: r.match for r in labeling.agreement_by_kind(grades).collect()} == {"sujet": 0.667, "ton": 0.5}
    assert [r.topic for r in labeling.of_kind(grades, grades.select("topic", grades.llm_kind.alias("kind"))).orderBy("topic").collect()] == [0, 2, 4]
