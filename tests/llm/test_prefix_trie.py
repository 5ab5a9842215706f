import hashlib
import random
import zlib

from quillspark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, salt long"


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), sum(1 for n in members if len(n) == len(node) + 1 and n[:-1] == node), sum(n not in inner for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 3, "x", 9) for r in rows], SCHEMA).repartition(6)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, **more).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        if c in (35, 70):
            continue  # families without a base
        rows += [(c, t, ["user", None][t % 2], rng.choice(["a", "b", "ü", ""]) * (1 + t % 3)) for t in range(rng.choice([1, 1, 2, 3, 5, 12]))]
    rows += [(300, None, "user", "first"), (300, -4, "user", "second"), (301, 0, "user", None)]
    rows += [(400 + 5 * i, t, "user", f"same {t}") for i in range(40) for t in range(6)]  # a large group of copies
    rows += [(700, t, "user", "deep") for t in range(60)] + [(703, t, "user", "deep") for t in range(60)]
    rows += [(None, 0, "user", "nobody")]
    want = brute(rows)
    assert rows_of(spark, rows) == want
    assert rows_of(spark, rows, block=4) == want  # long conversations and paths in blocks


def test_only_turnless(spark):
    """A conversation whose own turns are all replaced by those of a missing base is a member of the root alone."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert rows_of(spark, [(c, 0, "user", "a")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty(spark):
    assert rows_of(spark, [(None, 1, "a", "b")]) == []


def test_long_lists_of_ends_travel_in_chunks(spark, monkeypatch):
    frame = spark.createDataFrame([(1, 5, 6, i) for i in range(30_000, 0, -1)] + [(0, 0, 0, 4)], "depth long, k1 long, k2 long, conv_id long").repartition(5)
    got = {r.depth: r.ends_sha256 for r in prefix_trie.ends_digests(frame).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(1, 30_001))).encode()).hexdigest(), 0: hashlib.sha256(b"4").hexdigest()}
