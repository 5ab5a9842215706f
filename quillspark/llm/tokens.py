"""Byte-level BPE encoding and decoding; vocabulary files are read where they lie, by a path that is a parameter.

Pre-tokenisation uses no regular expression: every code point gets a class that already holds what it must know of
the one or two after it, a transition table over nine states says where a token starts, and the table's functions are
composed by an associative scan, so that blocks of text are worked on side by side.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspark.llm.bpe import PairTable, WordCache, merge_all
from quillspark.llm.common import ranges, slices, text_buffers

#: Classes of code points. Those of an apostrophe and of white space hold what follows.
OTHER, LETTER, NUMBER, SPACE_MID, SPACE_LAST, BLANK_LAST, QUOTE_1, QUOTE_2 = range(8)
#: States: what the current token is. LONE: the next code point starts a token whatever it is.
LONE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, PENDING, ONE_MORE, TWO_MORE = range(8)
STATES = 8
_BLOCK = 128


@lru_cache(maxsize=1)
def _unicode_classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    # White_Space property of Unicode: fixed values
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE_MID
    return out


@lru_cache(maxsize=1)
def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token), by class * STATES + state; classes from 8 on are those of a text's first code point."""
    go, cut = np.zeros((16, STATES), np.uint8), np.ones((16, STATES), bool)
    run = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    for kind, state in run.items():
        go[kind, :] = state
        cut[kind, [state, PENDING]] = False
    go[LETTER, ONE_MORE], go[LETTER, TWO_MORE] = LONE, ONE_MORE
    cut[LETTER, [ONE_MORE, TWO_MORE]] = False
    for kind, state in ((QUOTE_1, ONE_MORE), (QUOTE_2, TWO_MORE)):
        go[kind, :] = state
        go[kind, [IN_OTHER, PENDING]] = IN_OTHER
        cut[kind, [IN_OTHER, PENDING]] = False
    go[SPACE_MID, :] = IN_SPACE
    cut[SPACE_MID, IN_SPACE] = False
    go[SPACE_LAST, :], go[BLANK_LAST, :] = PENDING, LONE
    go[8:, :] = go[:8, [LONE]]
    cut[8:, :] = True
    return go.ravel(), cut.ravel()


def _classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point; first: where texts start."""
    kind = _unicode_classes()[points]
    n = len(kind)
    ends = np.zeros(n, bool)
    ends[first[1:] - 1] = True
    ends[-1] = True
    space = kind == SPACE_MID
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~ends[:-1]
    kind[last] = np.where(points[last] == 32, SPACE_LAST, BLANK_LAST)
    quote = np.flatnonzero((points == 39) & ~ends)
    if len(quote):
        b = points[quote + 1]
        kind[quote[np.isin(b, [ord(x) for x in "stmd"])]] = QUOTE_1
        far = quote[(quote + 2 < n)]
        far = far[~ends[far + 1]]
        two = points[far + 1].astype(np.int64) * 0x110000 + points[far + 2]
        kind[far[np.isin(two, [ord(x) * 0x110000 + ord(y) for x, y in ("re", "ve", "ll")])]] = QUOTE_2
    kind[first[first < n]] += 8
    return kind


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code point positions at which tokens start. first: the texts' first positions, ascending; empty texts repeat one."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    first = np.unique(first[first < n])
    go, cut = _machine()
    kind = _classes(points, first)
    blocks = -(-n // _BLOCK)
    padded = np.zeros(blocks * _BLOCK, np.uint8)
    padded[:n] = kind
    columns = np.ascontiguousarray(padded.reshape(blocks, _BLOCK).T) * np.uint8(STATES)
    # the function of each block: state before it -> state behind it
    f = np.broadcast_to(np.arange(STATES, dtype=np.uint8)[:, None], (STATES, blocks)).copy()
    for j in range(_BLOCK):
        f = go[columns[j] + f]
    # inclusive scan over the blocks; composition is associative, so it doubles its reach in each round
    reach = 1
    while reach < blocks:
        g = f.copy()
        g[:, reach:] = np.take_along_axis(f[:, reach:], f[:, :-reach], 0)
        f = g
        reach *= 2
    state = np.zeros(blocks, np.uint8)
    state[1:] = f[LONE, :-1]
    found = np.empty((_BLOCK, blocks), bool)
    for j in range(_BLOCK):
        at = columns[j] + state
        found[j] = cut[at]
        state = go[at]
    return np.flatnonzero(found.T.ravel()[:n])


class ByteBPE:
    """Ranks of a file of base64 tokens; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        left, right, rank = [], [], []
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(i)
        self.pairs = PairTable(*(np.array(x, np.int64) for x in (left, right)), np.array(rank, np.int32), np.array(rank, np.int32))
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.token_bytes = _Pieces(tokens)
        self.decimals = _Pieces([b"%d," % i for i in range(size)])
        self.cache = WordCache(self._encode_words)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = [*map(self.ranks.get, words)]
        rest = [i for i, k in enumerate(whole) if k is None]
        ids, sizes = merge_all(self.byte_ids[np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)], np.fromiter((len(words[i]) for i in rest), np.int64, len(rest)), self.pairs)
        counts = np.ones(len(words), np.int64)
        counts[rest] = sizes
        out = np.zeros(int(counts.sum()), np.int32)
        to = np.cumsum(counts) - counts
        alone = np.array([k is not None for k in whole], bool)
        out[to[alone]] = [k for k in whole if k is not None]
        out[ranges(to[rest], sizes)] = ids
        return out, counts

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, id offsets of the texts)."""
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        data = raw.tobytes()
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first = np.searchsorted(byte_of, offsets)
        starts = token_starts(points, first[:-1])
        cuts = byte_of[np.append(starts, len(points))].tolist()
        words = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        ids, counts = self.cache.ids(words)
        behind = np.concatenate([[0], np.cumsum(counts)])
        return ids, behind[np.searchsorted(starts, first)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, byte offsets of the texts)."""
        return self.token_bytes.join(ids, offsets)


class _Pieces:
    """Byte strings by number, joined for whole arrays of numbers."""

    def __init__(self, pieces: list[bytes]):
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, numbers: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[numbers]
        behind = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ranges(self.starts[numbers], sizes)], behind[offsets]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, the ids with the byte offset of each token.

    Null and empty texts have no ids and the hashes of empty strings. Repeated rows are encoded each for itself. Other
    columns of docs are left out, so their names cannot clash. Texts are worked on whole, in slices of about 2 MB; a
    longer text makes a slice of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for part in slices(batch, "text"):
                raw, offsets = text_buffers(part.column(1))
                ids, at = bpe.encode(raw, offsets)
                numbers, number_at = bpe.decimals.join(ids, at)
                decoded, decoded_at = bpe.decode(ids, at)
                n = part.num_rows
                listed = [numbers[number_at[i] : max(number_at[i], number_at[i + 1] - 1)] for i in range(n)]
                out = [
                    part.column(0),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
                    pa.array([hashlib.sha256(decoded[decoded_at[i] : decoded_at[i + 1]]).hexdigest() for i in range(n)]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    sizes = bpe.token_bytes.sizes[ids]
                    before = np.cumsum(sizes) - sizes
                    within = before - np.repeat(decoded_at[:-1], np.diff(at))
                    out += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (ids.astype(np.int32), within.astype(np.int64))]
                    names += ["ids", "byte_offsets"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, byte_offsets array<long>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", f"cast(`{text}` as string) text").mapInArrow(run, schema)


def decode_ids(frame: DataFrame, path: str) -> DataFrame:
    """doc_id, text of a table of doc_id, ids (array<int>); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            raw, cuts = bpe.decode(np.concatenate(lists) if len(lists) else np.zeros(0, np.int64), at)
            texts = [raw[cuts[i] : cuts[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return frame.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids").mapInArrow(run, "doc_id long, text string")
