"""N-gram Jaccard join with prefixes under several global token orders.

Two sets that share enough must share a token among the first few of each under any order of all tokens. With the
rarest tokens first, hardly a set has such a token that any other set knows. How many documents hold a token is counted
without a row per token: documents are dealt into chunks, a chunk sends its tokens in one sorted array per range of
hashes, and gets back one byte per token. A frequent token so costs an entry per chunk, not per document.

Equal texts are found first, by hashes alone, and only one of them is counted. A token of one text alone can be in no
intersection, so two sets also need few enough of such tokens between them.

Sets that are left meet by the tokens of their prefixes under the first order. First each set meets only the most
central set of each token (that of the most frequent tokens, which in a group of near copies is the one nearest to all),
then the most central one that is not tied yet; so a group of near copies is tied at the cost of its size. What is left
are pairs of different components, and all of them are looked at. A pair that meets must also share a token of the
prefixes under two other orders before its sets are fetched and compared.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import gram_hashes, mix64, saved, slices, text_buffers, word_hashes, word_spans
from quillspark.llm.components import connected_components

WORDS = 5
PERCENT = 80
#: A chunk and a range are what a task holds at once; with n documents there are at most n * n / 24 million messages, and never more than tokens.
CHUNK_DOCS = 3000
RANGE_DOCS = 8000
_SEED = 55
#: Orders by hashes, beside the first one by document frequency.
_HASH_ORDERS = (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)
_SET_FIELDS = "doc_id long, text_hash long, n long, known long, h1 long, h2 long, weight long, tokens binary, order1 array<long>, order2 array<int>, order3 array<int>"


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z are folded, a text of fewer words is one shingle."""
    raw, offsets = text_buffers(column)
    starts, ends, first = word_spans(raw, offsets)
    hashes = word_hashes(raw, starts, ends, _SEED, lower=True)
    grams = gram_hashes(hashes, words, _SEED)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(mix64(gram_hashes(hashes[a:b], b - a, _SEED) + np.uint64(b - a)))
        else:
            out.append(hashes[:0])
    return out


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """The least number of tokens that a set of n shares with any set it links to."""
    return -(-n * percent // 100)


def _sets_of(frame: pa.Table, words: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for batch in frame.combine_chunks().to_batches():
        for part in slices(batch, "text"):
            out += shingle_sets(part.column(part.schema.get_field_index("text")), words)
    return out


def _range_of(tokens: np.ndarray, ranges_: int) -> np.ndarray:
    return ((tokens >> np.uint64(40)) * np.uint64(ranges_)) >> np.uint64(24)


def _chunk_tokens(sets: list[np.ndarray], ranges_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct tokens of the chunk, ascending; documents of each; bounds of the ranges)."""
    tokens, counts = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
    return tokens, counts, np.searchsorted(_range_of(tokens, ranges_), np.arange(ranges_ + 1))


def _copies_in(frame: pa.Table, listed: list[bytes]) -> np.ndarray:
    """Which rows of a chunk repeat the text of a smaller document."""
    known = {*map(tuple, np.frombuffer(b"".join(listed), np.int64).reshape(-1, 2).tolist())}
    return np.array([i is None or (i, h) in known for i, h in zip(frame.column("doc_id").to_pylist(), frame.column("text_hash").to_pylist())], bool)


def _ask(words: int, ranges_: int):
    def run(frame: pa.Table, copies: pa.Table) -> pa.Table:
        again = _copies_in(frame, copies.column("ids").to_pylist())
        tokens, counts, bounds = _chunk_tokens([s for s, c in zip(_sets_of(frame, words), again) if not c], ranges_)
        some = [r for r in range(ranges_) if bounds[r + 1] > bounds[r]]
        low = (tokens & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        few = np.minimum(counts, 65535).astype(np.uint16)
        cut = lambda v, r: v[bounds[r] : bounds[r + 1]].tobytes()
        return pa.table({"range": pa.array(some, pa.int32()), "chunk": pa.array([frame.column("chunk")[0].as_py() if frame.num_rows else 0] * len(some), pa.int32()), "tokens": pa.array([cut(low, r) for r in some], pa.binary()), "counts": pa.array([zlib.compress(cut(few, r), 1) for r in some], pa.binary())})

    return run


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """A class of document frequency for each token that a chunk has sent: 0 for one document."""
    lists = [np.frombuffer(t, np.uint32) for t in frame["tokens"]]
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.uint16) for c in frame["counts"]])
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    tokens = np.concatenate(lists)
    order = np.argsort(tokens).astype(np.uint32)
    tokens = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    total = np.add.reduceat(counts[order], first, dtype=np.int64)
    classes = np.where(total < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(total, 2))))).astype(np.uint8)
    kind = np.empty(len(tokens), np.uint8)
    kind[order] = np.repeat(classes, np.diff(np.append(first, len(tokens))))
    return pd.DataFrame({"chunk": frame["chunk"], "range": frame["range"], "kinds": [zlib.compress(k.tobytes(), 1) for k in np.split(kind, cuts)]})


def _lists(values: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    sizes = [0 if v is None else len(v) for v in values]
    flat = np.concatenate([*(v for v in values if v is not None), np.zeros(0, np.int64)])
    mask = pa.array([v is None for v in values], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind), mask=mask)


def _survivors(words: int, ranges_: int, percent: int):
    """All documents with the size and the hash of their set; its known tokens and its prefixes where it may have a partner."""

    def run(frame: pa.Table, answers: pa.Table) -> pa.Table:
        asked = [(r, b) for r, b in zip(answers.column("range").to_pylist(), answers.column("kinds").to_pylist())]
        again = _copies_in(frame, [b for r, b in asked if r < 0])
        sets = _sets_of(frame, words)
        tokens, _, bounds = _chunk_tokens([s for s, c in zip(sets, again) if not c], ranges_)
        kinds = np.zeros(len(tokens), np.uint8)
        for r, blob in asked:
            if r >= 0:
                kinds[bounds[r] : bounds[r + 1]] = np.frombuffer(zlib.decompress(blob), np.uint8)
        numbers: list[list[int]] = [[], [], [], []]
        kept: list[bytes | None] = []
        prefixes: list[list[np.ndarray | None]] = [[], [], []]
        for own, copy in zip(sets, again):
            n = len(own)
            first = n - needed(n, percent) + 1
            kind = kinds[np.searchsorted(tokens, own)] if n and not copy else np.zeros(n, np.uint8)
            known = int(np.count_nonzero(kind))
            hashes = (int(mix64(x).sum(dtype=np.uint64).astype(np.int64)) if n else 0 for x in (own, own ^ np.uint64(_SEED)))
            for to, value in zip(numbers, (known, *hashes, int(kind.sum(dtype=np.int64)) * 1000 // max(n, 1))):
                to.append(value)
            if not n or n - known >= first:
                kept.append(None)
                for to in prefixes:
                    to.append(None)
                continue
            kept.append(own[kind > 0].tobytes())
            orders = [np.lexsort((own, kind))[:first], *(np.argsort(mix64(own ^ np.uint64(salt)))[:first] for salt in _HASH_ORDERS)]
            one, *others = (own[o][kind[o] > 0] for o in orders)
            prefixes[0].append(one.view(np.int64))
            for to, x in zip(prefixes[1:], others):
                to.append(x.astype(np.uint32).view(np.int32))
        columns = [frame.column("doc_id"), frame.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(v, pa.int64()) for v in numbers), pa.array(kept, pa.binary())]
        columns += [_lists(v, t) for v, t in zip(prefixes, (pa.int64(), pa.int32(), pa.int32()))]
        return pa.table(columns, names=[f.split()[0] for f in _SET_FIELDS.split(", ")])

    return run


def equal_texts(docs: DataFrame) -> DataFrame:
    """u, text_hash, v: each document and the smallest one with the same text, where that is another."""
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("u"), F.xxhash64("text").alias("text_hash"), F.xxhash64(F.lit("text"), "text").alias("h2"))
    first = hashed.groupBy("text_hash", "h2").agg(F.min("u").alias("v"), F.max("u").alias("last")).where("v < last").select("text_hash", "h2", "v")
    # written, so that a hot text can be split when it is joined
    return hashed.join(saved(first, "first-texts"), ["text_hash", "h2"]).where("u <> v").select("u", "text_hash", "v").distinct()


def _chunk_of(chunks: int, *columns: Column) -> Column:
    """Rows with a null id, which link with nothing, are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce(*columns)), F.lit(chunks)).cast("int").alias("chunk")


def _pack_copies(frame: pa.Table) -> pa.Table:
    both = np.stack([frame.column(c).to_numpy().astype(np.int64) for c in ("u", "text_hash")], axis=1)
    return pa.table({"chunk": frame.column("chunk").slice(0, 1), "ids": pa.array([both.tobytes()], pa.binary())})


def document_sets(docs: DataFrame, copies: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n, known, h1, h2, weight, and known tokens with prefixes of the sets that may have a partner.

    weight is the mean class of document frequency of the tokens.
    """
    n_docs = docs.count()
    chunks, ranges_ = max(1, -(-n_docs // CHUNK_DOCS)), max(1, -(-n_docs // RANGE_DOCS))
    hashed = F.xxhash64("text")
    dealt = docs.select("doc_id", "text", hashed.alias("text_hash"), _chunk_of(chunks, F.col("doc_id"), hashed))
    left_out = copies.select(_chunk_of(chunks, F.col("u")), "u", "text_hash").groupBy("chunk").applyInArrow(_pack_copies, "chunk int, ids binary")
    left_out = saved(left_out, "text-copies")
    asked = dealt.groupBy("chunk").cogroup(left_out.groupBy("chunk")).applyInArrow(_ask(words, ranges_), "range int, chunk int, tokens binary, counts binary")
    answers = asked.groupBy("range").applyInPandas(_answer, "chunk int, range int, kinds binary")
    answers = answers.unionByName(left_out.select("chunk", F.lit(-1).alias("range"), F.col("ids").alias("kinds")))
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_survivors(words, ranges_, percent), _SET_FIELDS)


def _linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int, percent: int) -> bool:
    """Whether sets of n_a and n_b tokens, of which a and b are those that other texts have, share enough."""
    if min(len(a), len(b), n_a, n_b) * 100 < percent * max(n_a, n_b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (n_a + n_b - both)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b, left, right = (c.to_pylist() for c in batch.columns)
            ok = [i for i in range(len(a)) if _linked(np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64), n_a[i], n_b[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], names=["u", "v"])

    return run


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: the pairs (a, b) that share a prefix token under each of the other orders, and then enough of their sets."""
    orders = lambda x: sets.select(F.col("rep").alias(x), F.col("order2").alias(f"{x}2"), F.col("order3").alias(f"{x}3"))
    # the side that may repeat much is joined while rows are short
    met = pairs.join(orders("b"), "b").join(orders("a"), "a").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
    met = saved(met.select("a", "b"), "candidates")
    side = lambda x, name: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(name))
    met = met.join(side("b", "right"), "b").join(side("a", "left"), "a")
    return met.select("a", "b", "n_a", "n_b", "left", "right").mapInArrow(_verified(percent), "u long, v long")


_FIELDS = ("rep", "component", "n", "known", "place")


def _central(placed: DataFrame, *more: Column) -> DataFrame:
    """The set of each token whose tokens are the most frequent ones, as columns with p_ before them."""
    top = F.max_by(F.struct(*_FIELDS), F.struct("weight", (-F.col("rep")).alias("r"))).alias("top")
    found = placed.groupBy("token").agg(top, *more)
    return found.select("token", *(F.col(f"top.{c}").alias(f"p_{c}") for c in _FIELDS), *(c for c in found.columns if c not in ("token", "top")))


def _pivots(placed: DataFrame) -> DataFrame:
    """The most central set of each token whose holders are of different components; p_least is the size of the smallest."""
    found = _central(placed, F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("p_least"))
    # written, so that a hot token can be split when it is joined
    return saved(found.where("low < high").drop("low", "high"), "pivots")


def _enough(x: str, n: Column, percent: int) -> Column:
    """Whether the known tokens of a set from this place on suffice for a partner of n tokens."""
    column = lambda c: F.col(f"{x}{c}")
    return (column("known") - column("place")) * (100 + percent) >= (column("n") + n) * percent


def _pivot_pairs(placed: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    met = placed.join(pivots, "token").where("component <> p_component")
    met = met.where(_enough("", F.col("p_n"), percent) & _enough("p_", F.col("n"), percent))
    return met.select(F.col("rep").alias("a"), F.col("p_rep").alias("b")).distinct()


def _left_pairs(placed: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that share a prefix token under the first order and could share enough.

    A set shares at most the `known` tokens that another text has; if a token is the first that two sets share, none of
    the known ones before it counts either. So a pair is proposed only where enough are left behind the token, and
    every pair that links is proposed at its first shared token. One side at least is outside the pivot's component.
    """
    least = F.greatest(F.col("p_least"), F.ceil(F.col("n") * percent / 100))
    rows = placed.join(pivots.select("token", "p_component", "p_least"), "token").where(_enough("", least, percent))
    rows = saved(rows.select("token", "rep", "n", "known", "place", "component", (F.col("component") == F.col("p_component")).alias("main")), "left-rows")
    a = rows.where("not main").select("token", *(F.col(c).alias(f"a_{c}") for c in ("rep", "n", "known", "place", "component")))
    b = rows.select("token", "main", *(F.col(c).alias(f"b_{c}") for c in ("rep", "n", "known", "place", "component")))
    fits = (F.col("a_component") != F.col("b_component")) & (F.col("main") | (F.col("a_rep") < F.col("b_rep"))) & _enough("a_", F.col("b_n"), percent) & _enough("b_", F.col("a_n"), percent)
    return a.join(b, "token").where(fits).select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()


def set_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """u, v: links that connect all sets which the links of all pairs of sets connect."""
    rows = saved(sets.select("rep", "n", "known", "weight", F.posexplode("order1").alias("place", "token")), "prefix-rows")
    placed = rows.withColumn("component", F.col("rep"))
    links = saved(verified_links(_pivot_pairs(placed, _pivots(placed), percent), sets, percent), "set-links")
    for turn in ("pivots that are not tied", "all that is left"):
        components = connected_components(links)
        placed = rows.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        pivots = _pivots(placed)
        if turn == "all that is left":
            pairs = _left_pairs(placed, pivots, percent)
        else:
            outside = placed.join(pivots.select("token", "p_component"), "token").where("component <> p_component").drop("p_component")
            pairs = _pivot_pairs(placed, saved(_central(outside), "pivots"), percent)
        found = saved(verified_links(pairs, sets, percent), "set-links")
        links = components.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(found)
    return links


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id: one row per row of docs.

    Links: at least `percent` of the union of two sets of word shingles is shared. Texts without words and null texts
    have empty sets, link with nothing and are their own component. Rows of one doc_id are one document where links
    are followed; rows with a null doc_id have a null component. Other columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    copies = saved(equal_texts(texts.where("text <> ''")), "equal-texts")
    found = saved(document_sets(texts, copies, words, percent), "shingle-sets")
    known = found.where("tokens is not null and doc_id is not null")
    # equal sets are one class, represented by their smallest document
    first = (F.first(c).alias(c) for c in ("weight", "tokens", "order1", "order2", "order3"))
    sets = saved(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("known").alias("known"), *first), "set-classes")
    member = known.select("doc_id", "n", "h1", "h2").join(sets.select("n", "h1", "h2", "rep"), ["n", "h1", "h2"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    blank = found.where("n = 0").select("doc_id", "text_hash")
    copies = copies.join(blank, (copies["u"] == blank["doc_id"]) & (copies["text_hash"] == blank["text_hash"]), "left_anti").select("u", "v")
    component = connected_components(set_links(sets, percent).unionByName(member).unionByName(copies))
    out = found.select("doc_id", "text_hash", F.col("n").alias("n_shingles")).join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without the documents whose component has a smaller document; all columns stay, null doc_ids too."""
    gone = link_components(docs, words, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
