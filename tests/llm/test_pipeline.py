import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import pii, toxicity
from quillspark.llm.common import table

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = table(spark, sf_dir, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert 0 < docs.count() < before
    assert docs.where("text like '%@%.example.com%'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def without_shared_lines(texts: dict) -> dict:
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(FOLD)
    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    stays = lambda i, x: len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)) for i, t in texts.items()}


def without_near_copies(texts: dict) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    low = {i: i for i in texts}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {i: t for i, t in texts.items() if low[i] == i}


def test_stages_by_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda frame: {r.doc_id: r.text for r in frame.collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, table(spark, sf_dir, "labels")).collect()}
    have = rows(docs)
    want = {i: t for i, t in have.items() if scores[i] < 0.3}
    docs = stages["toxicity"](spark, docs, sf_dir)
    assert rows(docs) == want
    for name, brute in (("line_dedup", without_shared_lines), ("jaccard_join", without_near_copies)):
        docs, want = stages[name](spark, docs, sf_dir), brute(want)
        assert rows(docs) == want, name
    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.report(docs).collect()}
    for i, found in spans.items():
        at, parts = 0, []
        for a, b, kind in sorted((int(a), -int(b), kind) for kind, a, b in found):
            if a >= at:
                parts += [want[i][at:a], f"[{kind}]"]
                at = -b
        want[i] = "".join([*parts, want[i][at:]]) if found else want[i]
    docs = stages["pii"](spark, docs, sf_dir)
    assert rows(docs) == want
    pieces = defaultdict(int)
    for r in stages["best_fit_packing"](spark, docs, sf_dir).collect():
        pieces[r.doc_id] += r.length
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert pieces == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in want.items()}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, tmp_path, empty):
    """Null ids and texts, empty texts, repeated rows, columns whose names the operators use; and no rows at all."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(0, "one two three four five six"), (0, "one two three four five six"), (1, None), (None, None), (None, "one two three four five six"), (2, ""), (3, long), (4, long + " end"), (5, "a line of ten\nx"), (6, "A line of ten\ny a@b.co")]
    frame = spark.createDataFrame([] if empty else rows, "doc_id long, text string")
    names = ("keep", "spans", "h1", "first", "chunk", "n", "token", "component", "shard", "_keep", "_lines", "score", "lang", "source")
    frame = frame.withColumns({c: F.lit(1) for c in names}).withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(0, 1, 0), (0, 1, 0), (3, 1, 0), (4, 1, 0), (6, 1, 0), (None, 1, 1), (1, None, None), (9, 1, 1)]
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == (set() if empty else {0, 1, 2, 3, 5, 6, None})
    # a document without its line, a long text in two pieces or more, repeated and null rows for themselves
    count = lambda i: sum(r.doc_id == i and r.piece == 0 for r in got)
    assert empty or [count(i) for i in (0, 1, 2, 3, 5, 6, None)] == [2, 1, 1, 1, 1, 1, 2]


def test_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
