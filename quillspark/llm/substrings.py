"""Substring dedup by suffix automata of reference shards.

The reference of a document is every document with a smaller id, so one broadcast automaton of everything would grow
with the corpus and each document would have to stream through every shard. Instead both sides are routed: the 50-word
windows of a text are grouped by their smallest 16-word hash (their anchor), runs of windows with one anchor are
segments, and a shard holds the segments of some anchors. Equal windows have equal anchors, so they meet in one shard;
windows whose anchor lies in one document alone go nowhere. A shard's automaton is built of its distinct segments, with
the smallest document of each state; streaming the segments through it gives matching statistics, and the state at
length 50 says whether a window starts in a smaller document. An anchor with very many distinct segments (a passage in
very many contexts) is not put into one task: its windows are hashed and aggregated one by one, which is exact too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import gram_hashes, mix64, ranges, saved, slices, sliding_min, text_buffers, word_hashes, word_spans

WINDOW = 50
GRAM = 16
SHARD_DOCS = 1500
#: Distinct segments of one anchor beyond which its windows are aggregated one by one.
HOT_SEGMENTS = 500
_SYMBOL = 5  # bytes of a word in a segment
_SEED = 2026
#: Of the two hashes of a segment; the factors are even.
_SALTS = [(np.uint64(0x51ED270B0F3C1A77), np.uint64(0x1E3779B97F4A7C14)), (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x36E8FEB86659FD92))]


def _segments(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of windows with one anchor, in a text's word hashes."""
    values = sliding_min(gram_hashes(hashes, gram, _SEED), window - gram + 1)
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], first, np.diff(np.append(first, len(values)))


def _of_batch(part: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the texts of a slice."""
    raw, offsets = text_buffers(part.column(column))
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, _SEED)
    for i in range(part.num_rows):
        yield i, hashes[first[i] : first[i + 1]]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [(i, np.unique(_segments(h, window, gram)[0])) for i, h in _of_batch(part, 1)]
                rows = np.repeat(np.array([i for i, _ in found], np.int64), [len(a) for _, a in found])
                anchors = np.concatenate([a for _, a in found]) if found else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), part.column(0).take(pa.array(rows))], names=["anchor", "doc_id"])

    return run


_FIELDS = "anchor long, h1 long, h2 long, doc_id long, text_hash long, start int, windows int, words binary"


def _candidates(window: int, gram: int):
    """Segments whose anchor is in the document's list of shared anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lists = part.column(3)
                columns: list[list] = [[] for _ in range(8)]
                for i, h in _of_batch(part, 1):
                    shared = np.array(lists[i].as_py() or [], np.int64)
                    if not len(shared):
                        continue
                    anchor, first, n = _segments(h, window, gram)
                    keep = np.isin(anchor.view(np.int64), shared)
                    anchor, first, n = anchor[keep], first[keep], n[keep]
                    size = n + window - 1
                    flat = h[ranges(first, size)]
                    behind = np.cumsum(size) - size
                    place = (np.arange(len(flat)) - np.repeat(behind, size)).astype(np.uint64)
                    two = [np.add.reduceat(mix64(flat ^ salt) * (place * factor + np.uint64(1)), behind) if len(flat) else flat for salt, factor in _SALTS]
                    symbols = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, :_SYMBOL]).tobytes()
                    cuts = (behind * _SYMBOL).tolist() + [len(flat) * _SYMBOL]
                    for to, values in zip(columns, (anchor.view(np.int64).tolist(), two[0].view(np.int64).tolist(), two[1].view(np.int64).tolist(), [part.column(0)[i].as_py()] * len(n), [part.column(2)[i].as_py()] * len(n), first.tolist(), n.tolist(), [symbols[a:b] for a, b in zip(cuts, cuts[1:])])):
                        to += values
                types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _FIELDS.split(", ")])

    return run


def _symbols(words: bytes) -> list[int]:
    out = np.zeros((len(words) // _SYMBOL, 8), np.uint8)
    out[:, :_SYMBOL] = np.frombuffer(words, np.uint8).reshape(-1, _SYMBOL)
    return out.view(np.uint64).ravel().tolist()


class Automaton:
    """A suffix automaton of several sequences; each state knows the smallest owner of the sequences it occurs in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [2**63 - 1]

    def add(self, sequence: list[int], owner: int) -> None:
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last = 0
        for c in sequence:
            q = nxt[last].get(c, -1)
            if q >= 0 and length[q] == length[last] + 1:
                last = q
            else:
                if q >= 0:
                    made = self._clone(last, c, q)
                else:
                    made = len(nxt)
                    nxt.append({}), length.append(length[last] + 1), link.append(0), owners.append(2**63 - 1)
                    p = last
                    while p >= 0 and c not in nxt[p]:
                        nxt[p][c] = made
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][c]
                        link[made] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = made
            if owner < owners[last]:
                owners[last] = owner

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        made = len(nxt)
        nxt.append(nxt[q].copy()), length.append(length[p] + 1), link.append(link[q]), self.owner.append(self.owner[q])
        link[q] = made
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = made
            p = link[p]
        return made

    def close(self) -> None:
        """Owners of longer states are owners of their suffixes."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            up = self.link[state]
            if up >= 0 and self.owner[state] < self.owner[up]:
                self.owner[up] = self.owner[state]

    def stream(self, sequence: list[int], window: int) -> list[int]:
        """For each window of the sequence, the smallest owner of its words; 2**63 - 1 if it does not occur."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        state, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            while matched >= window and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            if i >= window - 1:
                out.append(owners[state] if matched >= window else 2**63 - 1)
        return out


def _shard(window: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        automaton, sequences = Automaton(), [_symbols(w) for w in frame["words"]]
        for sequence, owner in zip(sequences, frame["first"].tolist()):
            automaton.add(sequence, owner)
        automaton.close()
        return pd.DataFrame({"h1": frame["h1"], "h2": frame["h2"], "firsts": [automaton.stream(s, window) for s in sequences]})

    return run


def _windows(window: int):
    """(h1, h2, place, w1, w2, first) of each window of the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for h1, h2, first, words in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for i in range(len(words) // _SYMBOL - window + 1):
                    d = hashlib.blake2b(words[i * _SYMBOL : (i + window) * _SYMBOL], digest_size=16).digest()
                    rows.append((h1, h2, i, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), first))
            columns = [*zip(*rows)] or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], names=["h1", "h2", "place", "w1", "w2", "first"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_docs: int = SHARD_DOCS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, text_hash, spans: per row with such words, the array of (from, to) word places covered by windows that start in a smaller document."""
    texts = _texts(docs).where("doc_id is not null")
    shards = max(1, -(-docs.count() // shard_docs))
    # written, so that the two uses do not hash the texts twice
    anchors = saved(texts.mapInArrow(_anchors(window, gram), "anchor long, doc_id long"), "substring-anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    # written, so that a hot anchor can be split when it is joined
    shared = saved(shared, "substring-shared")
    per_doc = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    listed = texts.withColumn("text_hash", F.xxhash64("text")).join(per_doc, "doc_id").select("doc_id", "text", "text_hash", "anchors")
    segments = saved(listed.mapInArrow(_candidates(window, gram), _FIELDS), "substring-segments")
    distinct = segments.groupBy("anchor", "h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.first("words").alias("words"))
    distinct = saved(distinct, "substring-distinct")
    crowded = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("anchor")
    crowded = saved(crowded, "substring-crowded")
    few = distinct.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    found = few.select("shard", "h1", "h2", "first", "words").groupBy("shard").applyInPandas(_shard(window), "h1 long, h2 long, firsts array<long>")
    many = distinct.join(crowded, "anchor", "left_semi").select("h1", "h2", "first", "words").mapInArrow(_windows(window), "h1 long, h2 long, place int, w1 long, w2 long, first long")
    owner = many.groupBy("w1", "w2").agg(F.min("first").alias("first"))
    in_order = F.array_sort(F.collect_list(F.struct("place", "owner.first")))
    many = many.drop("first").join(owner.alias("owner"), ["w1", "w2"]).groupBy("h1", "h2").agg(F.transform(in_order, lambda x: x["first"]).alias("firsts"))
    owners = found.unionByName(many)
    met = segments.select("h1", "h2", "doc_id", "text_hash", "start").join(owners, ["h1", "h2"])
    places = F.transform(F.filter(F.transform("firsts", lambda first, i: F.struct(first.alias("first"), (F.col("start") + i).alias("at"))), lambda x: x["first"] < F.col("doc_id")), lambda x: x["at"])
    runs = F.aggregate(
        places,
        F.array().cast("array<struct<a:int,b:int>>"),
        lambda acc, at: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= at), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), (at + window).alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(at.alias("a"), (at + window).alias("b"))))),
    )
    pieces = met.select("doc_id", "text_hash", runs.alias("runs")).where(F.size("runs") > 0)
    return pieces.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            raw, offsets = text_buffers(part.column(1))
            starts, ends, first = word_spans(raw, offsets)
            data, n, removed, kept = raw.tobytes(), [], [], []
            for i, spans in enumerate(part.column(2)):
                a, b = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
                stays = np.ones(len(a) + 1, np.int64)
                if spans.is_valid and (own := spans.as_py()):
                    steps = np.zeros(len(a) + 1, np.int64)
                    np.add.at(steps, [s["a"] for s in own], 1)
                    np.add.at(steps, [s["b"] for s in own], -1)
                    stays = (np.cumsum(steps) == 0).astype(np.int64)
                at = np.flatnonzero(stays[: len(a)])
                n.append(len(a)), removed.append(len(a) - len(at))
                kept.append(b" ".join([data[x:y] for x, y in zip(a[at].tolist(), b[at].tolist())]).decode())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_docs: int = SHARD_DOCS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed, text (the kept words, joined by one space) of each row.

    Words are runs without ASCII white space; null and empty texts have none. Repeated rows are one document and keep
    the same words; rows with a null doc_id keep all. Other columns are left out, so their names cannot clash.
    """
    spans = repeated_spans(docs, window, gram, shard_docs, hot)
    joined = _texts(docs).withColumn("text_hash", F.xxhash64("text")).join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, text string")
