import hashlib

import numpy as np

from quillspark.llm import vector_codes


def brute(rows, entries=256, rounds=4):
    """Plain Python integers; rows: (vec_id, vector), all of one size that four divides."""
    whole = [(i, [int(np.floor(float(x) * 1024)) for x in v]) for i, v in rows]
    width = len(whole[0][1]) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    starts = sorted(whole)[:entries]
    books = [[cut(v, p) for _, v in starts] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda a, book: min(range(len(book)), key=lambda e: (far(a, book[e]), e))
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, v in whole:
                groups.setdefault(near(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else books[p][e] for e in range(len(books[p]))]
    out = {}
    for i, v in whole:
        code = [near(cut(v, p), books[p]) for p in range(4)]
        out[i] = "".join(f"{e:02x}" for e in code), sum(far(cut(v, p), books[p][e]) for p, e in enumerate(code))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90], x[200] = x[7], 100.0
    rows = [(int(i), v.tolist(), [None, "a", "b"][i % 3], 1, "c") for i, v in enumerate(x)]
    odd = [(900, None, "a", 1, "c"), (901, [float("nan")] + [0.0] * 7, "a", 1, "c"), (902, [float("-inf")] + [0.0] * 7, "a", 1, "c"), (903, [None] + [0.0] * 7, "a", 1, "c")]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label string, dim int, salt string").repartition(7)
    codes, books = vector_codes.compress(frame)
    got = {r.vec_id: r for r in codes.collect()}
    want, digest = brute([r[:2] for r in rows])
    assert {i: (r.code, r.error) for i, r in got.items()} == want
    assert vector_codes.books_digest(books) == digest
    for label in (None, "a", "b"):
        assert {r.label_error for r in got.values() if r.label == label} == {sum(r.error for r in got.values() if r.label == label)}


def test_few_rows_other_sizes_and_repeated_ids(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, []), (3, [0.5, -0.5, 0.25, 1.0]), (3, [0.5, -0.5, 0.25, 1.0]), (3, [0.5, -0.5, 0.25, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (4, [3e38, -3e38, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress(frame)
    got = codes.collect()
    assert len(got) == 7 and {r.vec_id for r in got} == {1, 2, 3, 4, None}
    assert books[4].shape == (4, 3, 1) and books[5].shape == (4, 1, 2) and books[0].shape == (4, 1, 0)
    assert {(r.code, r.error) for r in got if r.vec_id in (1, 2)} == {("00000000", 0)}
    assert len({(r.code, r.error) for r in got if r.vec_id == 3}) == 2
    whole = vector_codes.integers(frame.where("vec_id = 4")).first().ints
    assert whole == [vector_codes.LARGEST, -vector_codes.LARGEST, 0, 0]
    none, books = vector_codes.compress(frame.limit(0))
    assert none.count() == 0 and books == {} and vector_codes.books_digest(books) == hashlib.sha256().hexdigest()


def test_decoded_vectors_are_near(spark):
    x = np.random.default_rng(1).normal(size=(100, 8))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    codes, books = vector_codes.compress(frame)
    for r in vector_codes.decode(codes, books, 8).collect():
        assert np.allclose(r.vector, x[r.vec_id], atol=1 / 1024 + 1e-9)  # every vector is an entry of its own
