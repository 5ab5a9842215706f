"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

All is learned from a bounded sample of labelled rows, dealt into FOLDS: the lexicon that makes a document's features
for the trees has not seen it, nor have the trees that give its margin to the calibration. What is broadcast with the
scoring tasks is bounded by LEXICON_TERMS and the number of trees. Scores depend on the text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import saved, slices, text_buffers

#: Bound of the labelled sample, and of the learned lexicon.
SAMPLE_ROWS = 12_000
LEXICON_TERMS = 5_000
FOLDS = 4
CUT = 0.3
STEMS = (4, 5, 6, 7)
NEAR = 5
#: Pronouns of the second person in four languages: fixed values.
SECOND = set("you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro".split())
#: Characters that stand for letters in disguised words: fixed values.
_DISGUISE = str.maketrans("013457@$!|", "oleastasil")
FEATURES = ("lexicon_density", "lexicon_log", "stem_density", "stem_log", "distinct", "strength", "near_second", "second_density", "capitals", "exclamations", "punctuation", "obfuscation", "log_words")


def normalised(word: str) -> str:
    """Lower case, without punctuation around it and with disguised letters restored."""
    w = word.lower().strip(".,;:!?\"'()[]{}<>*#%&$|-_/\\«»“”‘’…")
    if w and not w.isalpha() and any(c.isalpha() for c in w):
        w = "".join(c for c in w.translate(_DISGUISE) if c.isalpha())
    return w


def _terms(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    trees: list = field(default_factory=list)
    base: float = 0.0
    edges_x: list[float] = field(default_factory=list)
    edges_y: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += _apply(tree, x)
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a little of the uncalibrated score so that the order inside a step of the calibration stays."""
        margin = self.margins(x)
        plain = 1 / (1 + np.exp(-margin))
        steps = np.interp(margin, self.edges_x, self.edges_y) if self.edges_x else plain
        return np.clip(0.98 * steps + 0.02 * plain, 0.0, 1.0)


class Featurizer:
    """Features of texts under a lexicon; what is known of a word is cached in a worker."""

    def __init__(self, lexicon: dict[str, float], most: int = 300_000):
        self.lexicon, self.most = lexicon, most
        self._empty()

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 5))

    def _know(self, word: str) -> tuple:
        w = normalised(word)
        whole = self.lexicon.get(w, 0.0)
        stem = max((self.lexicon.get(w[:n] + "*", 0.0) for n in STEMS if len(w) >= n), default=0.0)
        letters = sum(c.isalpha() for c in word)
        odd = letters and not word.isalpha() and any(not c.isalpha() for c in word.strip(".,;:!?\"'()-*#%&$|"))
        return whole, stem, max(whole, stem), float(w in SECOND), float(bool(odd))

    def __call__(self, column: pa.Array) -> np.ndarray:
        texts = ["" if t is None else t for t in column.to_pylist()]
        lists = [t.split() for t in texts]
        words = [w for x in lists for w in x]
        if len(self.at) > self.most:
            self._empty()
        missing = [w for w in dict.fromkeys(words) if w not in self.at]
        if missing:
            self.at.update(zip(missing, range(len(self.at), len(self.at) + len(missing))))
            self.table = np.concatenate([self.table, np.array([self._know(w) for w in missing])])
        k = np.array([*map(self.at.__getitem__, words)], np.int64)
        sizes = np.array([len(x) for x in lists], np.int64)
        doc = np.repeat(np.arange(len(texts)), sizes)
        n = np.maximum(sizes, 1)
        t = self.table[k] if len(k) else np.zeros((0, 5))
        total = lambda v: np.bincount(doc, weights=v, minlength=len(texts))
        whole, stem, hit = t[:, 0] > 0, t[:, 1] > 0, t[:, 2] > 0
        hits = np.flatnonzero(hit)
        distinct = np.bincount(doc[hits[np.unique(doc[hits] * (int(k.max()) + 1) + k[hits], return_index=True)[1]]], minlength=len(texts)) if len(hits) else np.zeros(len(texts))
        near = np.zeros(len(k))
        second = np.flatnonzero(t[:, 3] > 0)
        if len(hits) and len(second):
            right = np.searchsorted(second, hits)
            for side in (np.minimum(right, len(second) - 1), np.maximum(right - 1, 0)):
                other = second[side]
                near[hits[(np.abs(other - hits) <= NEAR) & (doc[other] == doc[hits])]] = 1
        raw, offsets = text_buffers(column)
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        size = np.maximum(np.diff(offsets), 1)
        capital = (raw >= 65) & (raw <= 90)
        marks = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126))
        strength = np.zeros(len(texts))
        if len(hits):
            np.maximum.at(strength, doc[hits], t[hits, 2])
        columns = [total(whole) / n, np.log1p(total(whole)), total(stem) / n, np.log1p(total(stem)), distinct, strength, total(near) / np.maximum(total(hit), 1), total(t[:, 3]) / n, count(capital) / size, count(raw == 33) / size, count(marks) / size, total(t[:, 4]) / n, np.log1p(sizes)]
        return np.column_stack(columns) if len(texts) else np.zeros((0, len(FEATURES)))


# -- trees and calibration ---------------------------------------------------------------------------------------------


def _apply(tree: list, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    feature, cut, left, right, value = (np.array(v) for v in tree)
    for _ in range(16):
        inner = feature[at] >= 0
        if not inner.any():
            break
        go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return value[at]


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> tuple[list, float]:
    """(trees, base margin) of logistic boosting with Newton leaves over at most `bins` cuts a feature."""
    share = min(max(float(y.mean()) if len(y) else 0.1, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return [], base
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    codes = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)])
    margin, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-9
        nodes: list[list] = [[], [], [], [], []]  # feature, cut, left, right, value

        def grow(rows: np.ndarray, level: int) -> int:
            me = len(nodes[0])
            for v, d in zip(nodes, (-1, 0.0, 0, 0, rate * g[rows].sum() / (h[rows].sum() + 1.0))):
                v.append(d)
            best = (1e-6, -1, 0)
            if level < depth and len(rows) >= 2 * least:
                g_all, h_all = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs, hs, ns = (np.cumsum(np.bincount(codes[rows, f], weights=w, minlength=len(c) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + 1) + (g_all - gs) ** 2 / (h_all - hs + 1) - g_all**2 / (h_all + 1)
                    gain[(ns < least) | (len(rows) - ns < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
            if best[1] >= 0:
                go = codes[rows, best[1]] <= best[2]
                nodes[0][me], nodes[1][me] = best[1], float(cuts[best[1]][best[2]])
                nodes[2][me] = grow(rows[go], level + 1)
                nodes[3][me] = grow(rows[~go], level + 1)
            return me

        grow(np.arange(len(y)), 0)
        trees.append(nodes)
        margin += _apply(nodes, x)
    return trees, base


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots (margin, rate) of the non-decreasing fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # sum, weight, lowest, highest margin
    order = np.argsort(margin, kind="stable")
    for m, v in zip(margin[order].tolist(), y[order].tolist()):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([float(v), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in range(2)]
    return xs, ys


# -- learning and scoring ----------------------------------------------------------------------------------------------


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, toxic, fold: `rows` labelled documents at most that are not held out; of rows that repeat an id the last text in order counts."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 62))
    # a little more than the share, so that the limit, not the draw, makes the number
    picked = known.where(draw < min(1 << 62, int(1.1 * share * (1 << 62)) + 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = picked.orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id").limit(rows)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(F.broadcast(picked), "doc_id")  # `rows` rows of two numbers
    texts = texts.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return texts.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))


def term_counts(sample: DataFrame) -> DataFrame:
    """fold, term, pos, neg: documents of either kind with a term; the empty term counts all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, toxic, fold in zip(*(c.to_pylist() for c in batch.columns)):
                words = {normalised(w) for w in (text or "").split()}
                (pos if toxic else neg).update({(fold, t) for w in words if len(w) > 2 for t in _terms(w)} | {(fold, "")})
        keys = [*pos.keys() | neg.keys()]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (pos, neg))], names=["fold", "term", "pos", "neg"])

    counted = sample.select("text", "toxic", "fold").mapInArrow(run, "fold int, term string, pos long, neg long")
    return counted.groupBy("fold", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def learn_lexicon(counts: DataFrame, without: int = -1, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """Terms much more frequent in toxic documents of all folds but one, with the logarithm of the odds ratio."""
    c = counts.where(F.col("fold") != without).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = c.where("term = ''").first()
    if total is None:
        return {}
    odds = F.log((F.col("pos") + 0.5) / (total["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (total["neg"] + 1))
    found = c.where("term <> '' and pos >= 3 and neg <= 0.2 * pos").withColumn("odds", odds).where("odds > 2.0")
    rows = found.orderBy(F.desc(F.expr("odds * sqrt(pos)")), "term").limit(terms).collect()
    return {r["term"]: float(r["odds"]) for r in rows}


def _features(sample: DataFrame, lexicons: list[dict[str, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, toxic, fold) of the sample, which is bounded; each fold under its own lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = [Featurizer(x) for x in lexicons]
        for batch in batches:
            for k, lexicon in enumerate(make):
                own = batch.filter(pa.compute.equal(batch.column(3), k))
                for part in slices(own, "text"):
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(lexicon(part.column(1)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "fold", "x"])

    got = sample.select("doc_id", "text", "toxic", "fold").mapInArrow(run, "doc_id long, toxic int, fold int, x array<double>").orderBy("doc_id").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return x, got.column("toxic").to_numpy(), got.column("fold").to_numpy()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    sample = saved(training_sample(docs, labels, rows), "toxicity-sample")
    counts = saved(term_counts(sample), "toxicity-terms")
    x, y, fold = _features(sample, [learn_lexicon(counts, k) for k in range(FOLDS)])
    y = y.astype(float)
    model = Model(learn_lexicon(counts), *boost(x, y))
    if model.trees:
        margins = np.zeros(len(y))
        for k in range(FOLDS):
            margins[fold == k] = Model({}, *boost(x[fold != k], y[fold != k])).margins(x[fold == k])
        model.edges_x, model.edges_y = isotonic(margins, y)
    return model


def score(docs: DataFrame, model: Model, cut: float = CUT, with_features: bool = False) -> DataFrame:
    """doc_id, score, predicted of each row of docs; null and empty texts are scored as texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(model.lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                x = make(part.column(1))
                s = model.scores(x)
                out = [part.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(out + [pa.array(x.tolist(), pa.list_(pa.float64()))] * with_features, names=["doc_id", "score", "predicted"] + ["features"] * with_features)

    schema = "doc_id long, score double, predicted int" + ", features array<double>" * with_features
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Labels that are null, not 0 or 1, or of a null doc_id teach nothing; of repeated labels the larger one counts.
    Without labels of both kinds every score is the base rate. Other columns are left out, so their names cannot clash.
    """
    return score(docs, train(docs, labels, rows)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def reject_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """docs without the rows whose score is at least cut; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featurizer(model.lexicon)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.scores(make(part.column(part.schema.get_field_index("text")))) < cut))

    return docs.mapInArrow(run, docs.schema)
