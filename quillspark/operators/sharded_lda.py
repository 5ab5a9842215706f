"""LDA whose topic-word table is sharded by term, with learned priors of topics and of words.

Documents lie in blocks, terms (by their hashes) in slices; the counts of a block and a slice are one cell, packed once.
Cells are dealt to a grid of groups, bundles of slices by bundles of blocks, and stay there: a pass is one variational
step, in which a group gets the expected weights of its documents and of its terms, shares out its counts among the
topics and sums them for both. The grid has a fixed number of bundles until one would outgrow a task, so what travels in
a pass grows as the documents and the terms do, not as their product; beyond, it is split where least has to travel, and
cells are compressed until they are counted, one by one. The sums of a block or a slice are added up in a
stream, so that neither the vocabulary nor the documents are ever in one place. Both priors take Newton steps towards
the likelihood between passes; only numbers per topic come to the driver. No step lowers the bound of the likelihood but
by the rounding of weights, which travel in single precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.io import drop_kept, kept

#: Most terms of a shard, whose start is drawn together.
SHARD_TERMS = 1 << 18
#: Most terms of a bundle of slices, documents of a bundle of blocks, and entries of a group, of which a task holds one.
GROUP_TERMS, GROUP_DOCS, GROUP_ENTRIES = 1 << 21, 1 << 22, 1 << 25
#: Most documents of a block (their places fit in 16 bits) and words at which it ends.
BLOCK_DOCS, BLOCK_WORDS = 1 << 15, 1 << 22
#: Slices of the hashes, by their leading bits, and bundles of slices, if these are small enough.
SLICES, PARTS = 256, 8
#: Steps for each pass of an implementation that takes many steps per document in a pass.
STEPS = 2


def digamma(x: np.ndarray) -> np.ndarray:
    """By its recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, 1 / x, 0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def log_gamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        small = x < 6
        out = out - np.where(small, np.log(x), 0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), 0.0
    for _ in range(6):
        small = x < 6
        out = out + np.where(small, 1 / (x * x), 0)
        x = np.where(small, x + 1, x)
    r = 1 / (x * x)
    return out + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def _dirichlet_step(prior: np.ndarray, sums: np.ndarray, n: float, turns: int = 20) -> np.ndarray:
    """Newton steps of a Dirichlet prior towards n draws whose expected logarithms sum to `sums`; a step that does not help is halved."""
    value = lambda a: n * (log_gamma(a.sum()) - log_gamma(a).sum()) + ((a - 1) * sums).sum()
    for _ in range(turns):
        slope = n * (digamma(prior.sum()) - digamma(prior)) + sums
        q, z = -n * trigamma(prior), n * trigamma(prior.sum())
        step = (slope - (slope / q).sum() / (1 / z + (1 / q).sum())) / q
        before, size = value(prior), 1.0
        while size > 1e-6:
            new = prior - size * step
            if (new > 1e-8).all() and value(new) >= before:
                break
            size /= 2
        else:
            return prior
        if np.abs(new - prior).max() < 1e-7:
            return new
        prior = new
    return prior


def _symmetric_step(prior: float, total: float, draws: float, size: float, turns: int = 20) -> float:
    """The same for one number that all `size` entries of a Dirichlet prior share; total: sum of all expected logarithms."""
    value = lambda a: draws * (float(log_gamma(size * a)) - size * float(log_gamma(a))) + (a - 1) * total
    for _ in range(turns):
        slope = draws * size * float(digamma(size * prior) - digamma(prior)) + total
        bend = draws * size * float(size * trigamma(size * prior) - trigamma(prior))
        step, scale = (slope / bend if bend < 0 else -prior * np.sign(slope)), 1.0
        while scale > 1e-6 and not (prior - scale * step > 1e-8 and value(prior - scale * step) >= value(prior)):
            scale /= 2
        if scale <= 1e-6:
            return prior
        new = prior - scale * step
        if abs(new - prior) < 1e-9:
            return new
        prior = new
    return prior


@dataclass
class Counts:
    """The packed counts: cells, the documents of each block, the terms (hashes, sorted) of each slice; the grid is parts x rows, starts are drawn in `drawn` shards."""

    cells: DataFrame
    docs: DataFrame
    shards: DataFrame
    blocks: int
    parts: int
    rows: int
    drawn: int
    n_docs: int
    n_terms: int


_PIECE = "slice int, block long, size int, terms binary, df binary, doc binary, n binary"


def _pieces(streams: DataFrame, column: str, block_docs: int) -> DataFrame:
    """Per block and slice: distinct hashes, how many documents hold each, and these documents' places and counts; slice -1 has the block's size."""
    width = 64 - (SLICES - 1).bit_length()

    def packed(block: int, sizes: list[np.ndarray], words: list[np.ndarray]) -> pd.DataFrame:
        size = np.concatenate(sizes)
        flat = np.concatenate(words).view(np.uint64)
        rows = np.repeat(np.arange(len(size), dtype=np.uint16), size)
        order = np.argsort(flat, kind="stable")  # places stay ascending within a hash
        flat, rows = flat[order], rows[order]
        new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
        first = np.flatnonzero(new | np.r_[True, rows[1:] != rows[:-1]]) if len(flat) else np.zeros(0, int)
        n, doc = np.diff(np.r_[first, len(flat)]).astype(np.int32), rows[first]
        at = np.flatnonzero(new[first])
        terms, cuts = flat[first][at], np.r_[at, len(first)]
        df = np.diff(cuts).astype(np.int32)
        edges = np.r_[np.searchsorted(terms, np.arange(SLICES, dtype=np.uint64) << np.uint64(width)), len(terms)]
        out = [(-1, block, len(size), b"", b"", b"", b"")]
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            out.append((int(i), block, 0, terms[a:b].tobytes(), df[a:b].tobytes(), doc[cuts[a] : cuts[b]].tobytes(), n[cuts[a] : cuts[b]].tobytes()))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, words, docs, held, block = [], [], 0, 0, None
        out = lambda: pa.RecordBatch.from_pandas(packed(block, sizes, words), schema=schema, preserve_index=False)
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            at = 0
            while at < len(ids):
                to = min(len(ids), at + block_docs - docs, max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_WORDS - held, "right")) - 1))
                block = int(ids[at]) if block is None else block
                sizes.append(np.diff(offsets[at : to + 1])), words.append(flat[offsets[at] : offsets[to]].copy())
                docs, held, at = docs + to - at, held + int(offsets[to] - offsets[at]), to
                if docs >= block_docs or held >= BLOCK_WORDS or (at < len(ids) and held + int(offsets[at + 1] - offsets[at]) > BLOCK_WORDS):
                    yield out()
                    sizes, words, docs, held, block = [], [], 0, 0, None
        if docs:
            yield out()

    schema = pa.schema([("slice", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), *((c, pa.binary()) for c in ("terms", "df", "doc", "n"))])
    hashed = streams.select(F.monotonically_increasing_id().alias("doc"), F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("terms"))
    return hashed.mapInArrow(run, _PIECE)


def _held(no_below: int, most: float):
    """The cells of a slice with the terms in so many documents, by their places among its held hashes; these in a row of block -1."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["slice"].iloc[0])
        terms, df = ([np.frombuffer(x, t) for x in frame[c]] for c, t in (("terms", np.uint64), ("df", np.int32)))
        known, where = np.unique(np.concatenate(terms), return_inverse=True)
        total = np.bincount(where, np.concatenate(df).astype(np.float64), len(known))
        known = known[(total >= no_below) & (total <= most)]
        out = [(number, -1, 0, known.tobytes(), b"", b"", b"")]
        for block, own, count, doc, n in zip(frame["block"], terms, df, frame["doc"], frame["n"]):
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            stays = known[at] == own if len(known) else np.zeros(len(own), bool)
            if stays.any():
                each = np.repeat(stays, count)
                out.append((number, block, 0, at[stays].astype(np.int32).tobytes(), count[stays].tobytes(), np.frombuffer(doc, np.uint16)[each].tobytes(), np.frombuffer(n, np.int32)[each].tobytes()))
        return pd.DataFrame(out, columns=frame.columns)

    return run


def count_cells(streams: DataFrame, no_below: int, no_above: float, column: str = "grams", shard_terms: int = SHARD_TERMS, block_docs: int = BLOCK_DOCS) -> Counts:
    """Counts of all terms in at least no_below and at most a share no_above of the documents, however many there are.

    Terms are told apart by 64-bit hashes; the rows of `streams` are the documents.
    """
    pieces = kept(_pieces(streams, column, min(block_docs, 1 << 16)), "pieces")
    sizes = pieces.where("slice = -1").select("block", "size")
    blocks, n_docs = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    held = kept(pieces.where("slice >= 0").groupBy("slice").applyInPandas(_held(no_below, no_above * n_docs), _PIECE), "cells")
    numbers = lambda frames: (f.assign(ids=[np.arange(n).tobytes() for n in f["size"]])[["block", "ids"]] for f in frames)
    docs = kept(sizes.mapInPandas(numbers, "block long, ids binary"), "docs")
    drop_kept(pieces)
    n_terms, entries = held.agg(F.sum(F.expr("if(block = -1, length(terms), 0)")) / 8, F.sum(F.length("n")) / 4).first()
    n_terms, entries = int(n_terms or 0), int(entries or 0)
    parts, rows = grid(n_docs, n_terms, entries)
    shards = held.where("block = -1").select(F.col("slice").alias("shard"), F.col("terms").alias("hashes"))
    cells = held.where("block >= 0").select(_group(F.col("slice"), F.col("block"), parts, rows).alias("group"), "slice", "block", "terms", "df", "doc", "n")
    return Counts(cells, docs, shards, blocks, parts, rows, max(1, -(-n_terms // shard_terms)), n_docs, n_terms)


def grid(n_docs: int, n_terms: int, entries: int) -> tuple[int, int]:
    """Bundles of slices and of blocks whose groups hold bounded entries, documents and terms, such that the fewest weights travel."""
    groups, least = -(-entries // GROUP_ENTRIES), -(-n_docs // GROUP_DOCS)
    choices = [(parts, max(1, least, -(-groups // parts))) for parts in range(min(SLICES, max(PARTS, -(-n_terms // GROUP_TERMS))), SLICES + 1)]
    return min(choices, key=lambda c: n_docs * c[0] + n_terms * c[1])


_CELL = "group int, slice int, block long, terms binary, df binary, doc binary, n binary"
_TYPES = {"terms": np.int32, "df": np.int32, "doc": np.uint16, "n": np.int32}


def _thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells with compressed columns, each behind its size; terms by their gaps."""
    for batch in batches:
        for c, kind in _TYPES.items():
            raw = [np.diff(np.frombuffer(x, kind), prepend=np.int32(0)).tobytes() if c == "terms" else x for x in batch[c]]
            batch[c] = [len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw]
        yield batch


def _thick(c: str, raw: bytes) -> np.ndarray:
    x = np.frombuffer(pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), "zstd"), _TYPES[c])
    return np.cumsum(x, dtype=np.int32) if c == "terms" else x


def _group(number: Column, block: Column, parts: int, rows: int) -> Column:
    return F.pmod(F.xxhash64(block), F.lit(rows)).cast("int") * parts + F.pmod(number, F.lit(parts)).cast("int")


@dataclass
class Model:
    """shards: shard, hashes, weights (terms x topics); totals per topic; priors; the bound of the log likelihood at each step."""

    shards: DataFrame
    totals: np.ndarray
    alpha: np.ndarray
    eta: float
    bounds: list[float] = field(default_factory=list)


_STATE = "kind string, id long, weights binary"


def _added(parts: DataFrame, alpha: np.ndarray, eta: float, rows: int) -> DataFrame:
    """The sums of all parts of a block or slice and their prior, added in a stream; a slice met by one row of groups has one part, which stays where it is."""
    k = len(alpha)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, total = None, None
        done = lambda: pd.DataFrame({"kind": [name[0]], "id": [name[1]], "weights": [total.astype(np.float32).tobytes()]})
        for batch in batches:
            for kind, number, part in zip(batch["kind"], batch["id"], batch["part"]):
                x = np.frombuffer(part, np.float32).reshape(-1, k)
                if name == (kind, number):
                    total += x
                    continue
                if name is not None:
                    yield done()
                name, total = (kind, number), (alpha if kind == "doc" else eta) + x.astype(np.float64)
        if name is not None:
            yield done()

    gathered = lambda kinds: parts.where(kinds).repartition("kind", "id").sortWithinPartitions("kind", "id").mapInPandas(run, _STATE)
    if rows > 1:
        return gathered("kind <> 'bound'")
    return gathered("kind = 'doc'").unionByName(parts.where("kind = 'term'").mapInPandas(run, _STATE))


def _summary(state: DataFrame, alpha: np.ndarray, eta: float, totals: np.ndarray | None, n_terms: int) -> dict[str, np.ndarray]:
    """Per kind, sums over rows: of terms the weights per topic, or with totals the bound's share and the expected logarithms."""
    k = len(alpha)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, weights in zip(batch["kind"], batch["weights"]):
                x = np.frombuffer(weights, np.float32).reshape(-1, k).astype(np.float64)
                if totals is None:
                    out = x.sum(0)
                elif kind == "doc":
                    expected = digamma(x) - digamma(x.sum(1))[:, None]
                    bound = ((alpha - x) * expected + log_gamma(x) - log_gamma(alpha)).sum() + len(x) * float(log_gamma(alpha.sum())) - log_gamma(x.sum(1)).sum()
                    out = np.r_[expected.sum(0), bound]
                else:
                    expected = digamma(x) - digamma(totals)
                    bound = ((eta - x) * expected + log_gamma(x) - float(log_gamma(eta))).sum()
                    out = np.r_[expected.sum(0), bound]
                yield pd.DataFrame({"kind": kind, "at": np.arange(len(out), dtype=np.int32), "x": out})

    frame = state if totals is not None else state.where("kind = 'term'")
    rows = frame.mapInPandas(run, "kind string, at int, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")).collect()  # a few numbers per topic
    out = {kind: np.zeros(k + (totals is not None)) for kind in ("doc", "term")}
    for row in rows:
        out[row["kind"]][row["at"]] = row["x"]
    return out


def _drawn(counts: Counts, k: int, seed: int) -> DataFrame:
    """The seeded random start of the terms of each slice: drawn by shard, in the order of the hashes, and brought back."""
    shards = counts.drawn

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, raw in zip(batch["shard"], batch["hashes"]):
                hashes = np.frombuffer(raw, np.int64)
                shard = np.mod(hashes, shards)
                some = np.unique(shard)
                yield pd.DataFrame({"slice": np.int32(number), "shard": some, "hashes": [hashes[shard == i].tobytes() for i in some]})

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.int64) for x in frame["hashes"]]
        ends = np.cumsum([len(x) for x in hashes])
        order = np.argsort(np.concatenate(hashes))
        x = np.empty((len(order), k), np.float32)
        x[order] = np.random.default_rng([seed, int(frame["shard"].iloc[0])]).gamma(1.0, 1.0, x.shape)
        return frame.assign(weights=[part.tobytes() for part in np.split(x, ends[:-1])])[["slice", "hashes", "weights"]]

    def back(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(np.frombuffer(b"".join(frame["hashes"]), np.uint64))
        x = np.frombuffer(b"".join(frame["weights"]), np.float32).reshape(-1, k)[order]
        return pd.DataFrame({"kind": ["term"], "id": [int(frame["slice"].iloc[0])], "weights": [x.tobytes()]})

    drawn = counts.shards.mapInPandas(dealt, "slice int, shard long, hashes binary").groupBy("shard").applyInPandas(draw, "slice int, hashes binary, weights binary")
    return drawn.groupBy("slice").applyInPandas(back, _STATE)


def fit(counts: Counts, k: int, steps: int = 10 * STEPS, seed: int = 42, learn_priors: bool = True) -> Model:
    """k topics after so many steps, from a seeded random start.

    Priors start at 1 / k and are learned in the second half: before topics differ, all documents look alike, and a prior
    that has learnt this would keep them so.
    """
    alpha, eta = np.full(k, 1 / k), 1 / k

    def ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, ids in zip(batch["block"], batch["ids"]):
                yield pd.DataFrame({"kind": ["doc"], "id": [number], "weights": [np.ones((len(ids) // 8, k), np.float32).tobytes()]})

    groups = counts.parts * counts.rows
    # more partitions than groups, as hashes of few numbers collide
    placed = replace(counts, cells=counts.cells.mapInPandas(_thin, _CELL).repartition(4 * groups, "group").sortWithinPartitions("group").persist(StorageLevel.DISK_ONLY))
    state = kept(counts.docs.mapInPandas(ones, _STATE).unionByName(_drawn(counts, k, seed)), "lda")
    totals = _summary(state, alpha, eta, None, counts.n_terms)["term"]
    bounds = []
    for step in range(steps):
        parts = _shared_out(placed, state, totals, k).persist(StorageLevel.DISK_ONLY)  # made anew from the kept state, should an executor be lost
        sums = _summary(state, alpha, eta, totals, counts.n_terms)
        words = parts.where("kind = 'bound'").agg(F.sum("value")).first()[0] or 0.0
        fixed = k * float(log_gamma(counts.n_terms * eta)) - log_gamma(totals).sum() if counts.n_terms else 0.0
        bounds.append(float(words + sums["doc"][-1] + sums["term"][-1] + fixed))
        if learn_priors and step >= steps // 2 and counts.n_terms and counts.n_docs:
            alpha = _dirichlet_step(alpha, sums["doc"][:-1], counts.n_docs)
            eta = _symmetric_step(eta, float(sums["term"][:-1].sum()), k, counts.n_terms)
        after = kept(_added(parts, alpha, eta, counts.rows), "lda")
        parts.unpersist()
        drop_kept(state)
        state = after
        totals = _summary(state, alpha, eta, None, counts.n_terms)["term"]
    placed.cells.unpersist()
    shards = counts.shards.join(state.where("kind = 'term'").select(F.col("id").alias("shard"), "weights"), "shard")
    return Model(shards, totals, alpha, eta, bounds)


def _shared_out(counts: Counts, state: DataFrame, totals: np.ndarray, k: int) -> DataFrame:
    """kind, id, part, value: each group's counts shared out among the topics, summed by document and by term; its words' share of the bound.

    Every block and every slice of the group has a row, also where it has no counts: a slice's in each row of groups, a
    block's in each bundle of slices that holds a cell. The weights travel, the cells (of _thin()) do not if they lie by
    group.
    """

    def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weights = []
            for kind, raw in zip(batch["kind"], batch["weights"]):
                x = np.frombuffer(raw, np.float32).reshape(-1, k).astype(np.float64)
                weights.append(np.exp(digamma(x) - (digamma(x.sum(1))[:, None] if kind == "doc" else digamma(totals))).astype(np.float32).tobytes())
            yield batch.assign(weights=weights)

    def run(cells: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        known = {(kind, number): np.frombuffer(raw, np.float32).reshape(-1, k) for kind, number, raw in zip(sent["kind"], sent["id"], sent["weights"])}
        sums, bound = {name: np.zeros(x.shape, np.float32 if name[0] == "doc" else np.float64) for name, x in known.items()}, 0.0
        for number, block, terms, df, doc, n in zip(*(cells[c] for c in ("slice", "block", "terms", "df", "doc", "n"))):
            term, each, d, c = (_thick(*x) for x in (("terms", terms), ("df", df), ("doc", doc), ("n", n)))
            theta, beta = known["doc", block], known["term", number]
            for_doc = sums["doc", block]
            share = theta[d].astype(np.float64) * np.repeat(beta[term], each, axis=0)
            whole = np.maximum(share.sum(1), 1e-300)
            bound += float((c * np.log(whole)).sum())
            share *= (c / whole)[:, None]
            sums["term", number][term] += np.add.reduceat(share, np.cumsum(each) - each, axis=0)
            for i in range(k):
                for_doc[:, i] += np.bincount(d, share[:, i], len(for_doc))
        out = [(kind, number, x.astype(np.float32).tobytes(), 0.0) for (kind, number), x in sums.items()] + [("bound", 0, b"", bound)]
        return pd.DataFrame(out, columns=["kind", "id", "part", "value"])

    known = state.mapInPandas(expected, _STATE)
    bundles, rows = F.sequence(F.lit(0), F.lit(counts.parts - 1)), F.sequence(F.lit(0), F.lit(counts.rows - 1))
    to = F.when(F.col("kind") == "doc", F.transform(bundles, lambda i: _group(i, F.col("id"), counts.parts, counts.rows))).otherwise(F.transform(rows, lambda r: r.cast("int") * counts.parts + F.pmod("id", F.lit(counts.parts)).cast("int")))
    sent = known.select(F.explode(to).alias("group"), "kind", "id", "weights")
    return counts.cells.groupBy("group").cogroup(sent.groupBy("group")).applyInPandas(run, "kind string, id long, part binary, value double")


def topic_words(model: Model, streams: DataFrame, topn: int, name: str, column: str = "grams") -> DataFrame:
    """model, topic, rank, word by falling probability, ties by hash; the words are looked up in the streams."""
    k, totals = len(model.totals), model.totals

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw_hashes, weights in zip(batch["hashes"], batch["weights"]):
                hashes, x = np.frombuffer(raw_hashes, np.int64), np.frombuffer(weights, np.float32).reshape(-1, k)
                for topic in range(k):
                    share = x[:, topic] / totals[topic]
                    few = np.argsort(-share, kind="stable")[:topn]
                    yield pd.DataFrame({"topic": np.int32(topic), "hash": hashes[few], "share": share[few]})

    by = Window.partitionBy("topic").orderBy(F.desc("share"), "hash")
    top = model.shards.mapInPandas(best, "topic int, hash long, share double").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= topn)
    top = kept(top, "top-terms")
    wanted = F.broadcast(top.select("hash").distinct())  # topics x topn rows
    words = streams.select(F.explode(column).alias("word")).withColumn("hash", F.xxhash64("word")).join(wanted, "hash").groupBy("hash").agg(F.min("word").alias("word"))
    return top.join(words, "hash").select(F.lit(name).alias("model"), "topic", F.col("rank").cast("int").alias("rank"), "word")


def save(model: Model, path: str) -> None:
    """The shards as a table, totals and priors as another."""
    model.shards.write.mode("overwrite").parquet(f"{path}/shards")
    rows = [(model.totals.tolist(), model.alpha.tolist(), model.eta, model.bounds)]
    model.shards.sparkSession.createDataFrame(rows, "totals array<double>, alpha array<double>, eta double, bounds array<double>").write.mode("overwrite").parquet(f"{path}/priors")


def load(spark, path: str) -> Model:
    row = spark.read.parquet(f"{path}/priors").first()
    return Model(spark.read.parquet(f"{path}/shards"), np.array(row.totals), np.array(row.alpha), row.eta, row.bounds)
