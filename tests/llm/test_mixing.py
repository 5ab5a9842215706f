import hashlib

import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, rate string, `row` int"


def draw(doc_id, seed):
    digest = hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()
    return (int(digest[:13], 16) + seed * int(digest[13:26], 16)) % 2**52


def brute(rows):
    """Targets by the rule's own words: share, stop what is above, share the excess again."""
    sized = [(d, s, len((t or "").split())) for d, t, s in rows]
    names = sorted({s for _, s, _ in sized if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, s, _ in sized)
    total = {n: sum(z for _, s, z in sized if s == n) for n in names}
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        above = {n for n in free if share[n] >= 2 * total[n]}
        if not above:
            target |= share
            break
        target |= {n: 2.0 * total[n] for n in above}
        left -= sum(2.0 * total[n] for n in above)
        free -= above
    return sized, total, target


def fixture():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 5}") for i in range(200)]
    rows += [(1000 + i, "a b\tc\x0bd\x1ce  f", "huge") for i in range(150)]
    return rows + [(2000, None, "empty"), (2001, "", "empty"), (2002, "x y", None), (None, "p q r", None), (7, rows[7][1], "s2"), (7, rows[7][1], "s2"), (2003, "é ü", "É"), (2004, " ".join(["long"] * 100_000), "s1")]


def test_against_brute_force(spark):
    rows = fixture()
    frame = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], SCHEMA)
    got = mixing.mixture(frame.repartition(5)).collect()
    sized, total, target = brute([(d, t.replace("\x1c", "_").replace(" ", "_") if t else t, s) for d, t, s in rows])
    assert sorted((str(r.doc_id), str(r.source), r["size"]) for r in got) == sorted((str(d), str(s), z) for d, s, z in sized)
    taken = dict.fromkeys(total, 0)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source])
        assert r.copies in (int(r.rate), int(r.rate) + 1) and r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
    for name in total:
        # the best of the seeds
        rate = target[name] / total[name] if total[name] else 0
        own = [(d, z) for d, s, z in sized if s == name]
        gaps = [abs(sum(z * (int(rate) + (draw(d, seed) < (rate - int(rate)) * 2**52)) for d, z in own) - target[name]) for seed in range(mixing.SEEDS)]
        assert abs(taken[name] - target[name]) == pytest.approx(min(gaps))
    again = mixing.mixture(frame.repartition(2)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_copies_of_the_rows(spark):
    frame = spark.createDataFrame([(*r, 5, "x", 1) for r in fixture()], SCHEMA)
    want = {(r.doc_id, r.source): r.copies for r in mixing.mixture(frame).collect()}
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns
    counts = {(r.doc_id, r.source): r["count"] for r in mixed.groupBy("doc_id", "source").count().collect()}
    rows = {(r.doc_id, r.source): r["count"] for r in frame.groupBy("doc_id", "source").count().collect()}
    assert counts == {k: n * rows[k] for k, n in want.items() if n}


def test_one_source_and_none(spark):
    frame = spark.createDataFrame([(i, "a b c d", None) for i in range(4)], "doc_id long, text string, source string")
    assert {(r.target, r.source) for r in mixing.mixture(frame).collect()} == {(24.0, None)}
    assert mixing.mixture(frame.limit(0)).count() == 0
    assert [r.taken for r in mixing.mixture(frame.withColumn("text", F.lit(None))).collect()] == [0] * 4
