"""Sum-of-squares packing of tokenized documents into sequences of a fixed size.

Documents are tokenized once; only pieces shorter than a sequence are packed, one at most per document. They are dealt
into shards of a bounded number of documents, so no task grows with the corpus, and every shard packs its own pieces.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bpe import PairTable, WordCache, merge_all
from quillspark.llm.common import slices

CAPACITY = 2048
SHARD_DOCS = 8192


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points that this Python does not know; the tokenizer library may know newer ones, so it gets their texts."""
    known = np.array([unicodedata.category(chr(c)) != "Cn" for c in range(0x110000)] + [True])
    bounds = np.flatnonzero(np.diff(np.concatenate([[True], known]))).reshape(-1, 2)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in bounds.tolist()) + "]")


#: Marks that end many words; the pattern makes one behind letters a piece of its own.
_MARKS = frozenset(".,;:!?")
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_WHITE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


class WordBPE:
    """The ids of a tokenizers file with word ends, by cached merging; texts that hold a special token or a code point unknown here go to the library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        end = model["end_of_word_suffix"]
        shown = _byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.final = np.array([vocab[c + end] for c in shown], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, new = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]))
        self.pairs = PairTable(left, right, np.arange(len(merges), dtype=np.int32), new.astype(np.int32))
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.path, self.library, self.unknown = path, None, _unassigned()
        self.cache = WordCache(self._encode_words)
        self.merged = WordCache(self._merge_pieces)  # the same piece comes with many capitals and marks

    def _merge_pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data = [p.encode() for p in parts]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        flat = self.inner[raw]
        last = np.cumsum(lengths) - 1
        flat[last] = self.final[raw[last]]
        return merge_all(flat, lengths, self.pairs)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has; a word with an unknown code point has the one id -1."""
        parts, per_word, odd = [], np.ones(len(words), np.int64), []
        for i, w in enumerate(words):
            if w.isascii():
                w = w.lower()
            elif not w.isprintable() and self.unknown.search(w):  # the first is cheap; unassigned code points are not printable
                odd.append(i)
                parts.append("a")
                continue
            else:
                w = unicodedata.normalize("NFC", w)
                w = "".join([c.lower() for c in w]) if "Σ" in w else w.lower()  # only that letter depends on its place
            if w.isalpha():
                parts.append(w)
                continue
            if w[-1] in _MARKS and (head := w[:-1]).isalpha():  # the pattern splits before the mark
                per_word[i] = 2
                parts += (head, w[-1])
                continue
            own = self.pieces(w)
            per_word[i] = len(own)
            parts += own
        ids, sizes = self.merged.ids(parts)
        behind = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.concatenate([[0], np.cumsum(per_word)])
        if odd:
            ids[behind[cuts[odd]]] = -1
        return ids, np.diff(behind[cuts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        by_library = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        lists = [self._words(t) for t in texts]
        for i in by_library:
            lists[i] = []
        ids, counts = self.cache.ids([w for x in lists for w in x])
        behind = np.concatenate([[0], np.cumsum(counts)])
        ends = behind[np.cumsum([len(x) for x in lists])] if lists else []
        out = np.split(ids, ends[:-1]) if lists else []
        if len(ids) and ids.min() < 0:
            by_library += [i for i, own in enumerate(out) if len(own) and own.min() < 0]
        for i in by_library:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out

    @staticmethod
    def _words(text: str) -> list[str]:
        return [w for w in _WHITE.split(text) if w] if _ODD_SPACE.search(text) else text.split()


def _byte_characters() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBPE:
    return WordBPE(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and end_id, cut at multiples of capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = ["" if t is None else t for t in part.column(1).to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(part.column(0).to_pylist(), bpe.encode(texts)):
                    data = np.append(ids, end_id).astype("<u4")
                    for k in range(0, len(data), capacity):
                        own = data[k : k + capacity]
                        rows.append((doc_id, k // capacity, k, len(own), zlib.crc32(own.tobytes())))
                columns = [*zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(x, pa.int64()) for x in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item; longest items first, ties in the given order.

    An item goes into the open bin where the sum over residual gaps of the squared number of open bins with that gap
    becomes smallest; among equals into the smallest gap, and into a new bin only if it fits in none. Full bins do not count.
    """
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: dict[int, list[int]] = defaultdict(list)
    bins, offsets, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in order:
        s = int(lengths[i])
        to = -1
        here = counts[s:capacity]
        if here.any():
            change = 2 * (counts[: capacity - s] - here)  # the change of the sum, less two
            change[0] = -2 * counts[s] - 1  # a bin that becomes full leaves the sum
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            to = int(change.argmin())
        if to < 0:
            b, gap = n, capacity
            n += 1
        else:
            gap = s + to
            b = open_bins[gap].pop()
            counts[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack(pieces_: DataFrame, n_docs: int, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces. A full piece is a sequence of its own; sequence ids are shard * 2**32 + number."""
    shards = max(1, -(-n_docs // shard_docs))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["shard"].astype("int64") * 2**32 + bins, offset=offsets).drop(columns="shard")

    # rows are dealt by their place, not by a key, so that no id and no text fills a shard
    dealt = pieces_.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, monotonically_increasing_id()), {shards}) as int)"))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds the end id alone. Repeated rows are packed each for itself, rows
    with a null doc_id too. Other columns of docs are left out, so their names cannot clash. An empty table gives none.
    """
    return pack(pieces(docs, path, capacity), docs.count(), capacity, shard_docs)
