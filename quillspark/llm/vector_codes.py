"""Vector code compression: integer codebooks per part of a vector, fitted in rounds, all arithmetic exact.

Vectors are turned into integers once and written. In each round the codebooks (entries x components, a bounded size)
are broadcast; Arrow batches compute the distances of a part to all entries by the expansion of the square, with int64
matrix products, and take the first smallest. A task adds up its parts per entry; a grouped shuffle merges the sums of
all tasks, of which entries x components numbers come back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillspark.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are held within this, so that no distance of parts of up to 64 components leaves int64.
LARGEST = 1 << 27
#: Bytes of codebooks that are broadcast together; vectors of further sizes take another turn.
BOOK_BYTES = 256 << 20
SALTS = 32
#: Rows whose distances are held at once.
_ROWS = 4096

Books = dict[int, np.ndarray]


def integers(frame: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, dim, ints of the rows that take part: vectors of which no component is null or not finite."""
    vector = F.col("embedding").cast("array<double>")
    rows = frame.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vector.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    inside = lambda x: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), x * float(scale)))
    whole = F.transform("v", lambda x: F.floor(inside(x)))
    return rows.where(F.col("v").isNotNull() & finite).select("vec_id", "label", F.size("v").alias("dim"), whole.alias("ints"))


def _matrices(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, vectors as rows x parts x width) of each size in the batch, a bounded number of rows at once."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for rows in np.array_split(at, max(1, -(-len(at) // _ROWS))):
            lists = batch.column("ints").take(pa.array(rows))
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), int(dim))
            width = -(-int(dim) // parts)
            wide = np.zeros((len(rows), parts * width), np.int64)
            wide[:, : int(dim)] = x
            yield int(dim), rows, wide.reshape(len(rows), parts, width)


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of each row, by integers alone."""
    gaps = (x * x).sum(axis=1)[:, None] - 2 * (x @ np.ascontiguousarray(book.T)) + (book * book).sum(axis=1)[None, :]
    first = gaps.argmin(axis=1)
    return first, gaps[np.arange(len(x)), first]


def first_books(vectors: DataFrame, parts: int, entries: int) -> Books:
    """Per size, the parts of the vectors with the smallest ids, ascending, null last; of repeated ids the smallest vector."""
    ids = vectors.select("dim", "vec_id").distinct()
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.asc_nulls_last("vec_id")))
    smallest = ids.withColumn("place", rank).where(F.col("place") <= entries)  # each task sends `entries` ids of a size at most
    asked = F.broadcast(smallest.withColumnRenamed("vec_id", "id").withColumnRenamed("dim", "size"))
    met = vectors.join(asked, F.col("vec_id").eqNullSafe(F.col("id")) & (F.col("dim") == F.col("size")))
    chosen = met.groupBy("dim", "place").agg(F.min("ints").alias("ints")).orderBy("dim", "place").toArrow()
    books: dict[int, list[np.ndarray]] = {}
    for dim, rows, x in _matrices(chosen.combine_chunks().to_batches()[0], parts) if chosen.num_rows else ():
        books.setdefault(dim, []).append(x)
    return {dim: np.ascontiguousarray(np.concatenate(x).transpose(1, 0, 2)) for dim, x in books.items()}


def _next_books(vectors: DataFrame, books: Books, parts: int) -> Books:
    """One round: parts to their nearest entry, entries to the floor of their mean; unused ones stay."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {dim: np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64) for dim, book in sent.value.items()}
        for batch in batches:
            for dim, _, x in _matrices(batch, parts):
                for part in range(parts):
                    entry, _ = nearest_entries(x[:, part], sent.value[dim][part])
                    order = np.argsort(entry, kind="stable")
                    used, first = np.unique(entry[order], return_index=True)
                    total[dim][part, used, :-1] += np.add.reduceat(x[order, part], first, axis=0) if x.shape[2] else 0
                    total[dim][part, used, -1] += np.diff([*first, len(order)])
        for dim, table in total.items():
            part, entry = np.nonzero(table[:, :, -1])
            if len(part):
                values = table[part, entry]
                offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_pydict({"dim": np.full(len(part), dim, np.int32), "part": part.astype(np.int32), "entry": entry.astype(np.int32), "sums": pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))})

    told = vectors.select("dim", "ints").mapInArrow(sums, "dim int, part int, entry int, sums array<long>")
    merged = told.select("dim", "part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("dim", "part", "entry", "at").agg(F.sum("x").alias("x")).toArrow()
    sent.unpersist()
    out = {}
    dims, part, entry, at, x = (merged.column(c).to_numpy() for c in ("dim", "part", "entry", "at", "x"))
    for dim, book in books.items():
        own = dims == dim
        table = np.zeros((*book.shape[:2], book.shape[2] + 1), np.int64)
        table[part[own], entry[own], at[own]] = x[own]
        count = table[:, :, -1:]
        out[dim] = np.where(count > 0, table[:, :, :-1] // np.maximum(count, 1), book)
    return out


def books_digest(books: Books) -> str:
    """SHA-256 of all integers by size, part, entry and position, joined by commas."""
    digest, first = hashlib.sha256(), True
    for dim in sorted(books):
        for row in books[dim].reshape(-1, books[dim].shape[2]):
            if len(row):
                digest.update(("" if first else ",").encode() + ",".join(map(str, row.tolist())).encode())
                first = False
    return digest.hexdigest()


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """Codebooks of integers() per size of vector: parts x entries x width."""
    books = first_books(vectors, parts, entries)
    for _ in range(rounds):
        group: Books = {}
        for dim in sorted(books):
            group[dim] = books[dim]
            if sum(b.nbytes for b in group.values()) >= BOOK_BYTES or dim == max(books):
                books |= _next_books(vectors.where(F.col("dim").isin([*group])), group, parts)
                group = {}
    return books


def encode(vectors: DataFrame, books: Books, parts: int = PARTS) -> DataFrame:
    """vec_id, label, code, error: the entries of the parts, two hex digits each (more beyond 256 entries), and their squared distances."""
    sent = vectors.sparkSession.sparkContext.broadcast(books)
    digits = max(2, *(len(f"{b.shape[1] - 1:x}") for b in books.values())) if books else 2

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, error = np.zeros((batch.num_rows, parts), np.int64), np.zeros(batch.num_rows, np.int64)
            for dim, rows, x in _matrices(batch, parts):
                for part in range(parts):
                    found[rows, part], gap = nearest_entries(x[:, part], sent.value[dim][part])
                    error[rows] += gap
            text = ["".join(f"{i:0{digits}x}" for i in row) for row in found.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    fields = StructType([vectors.schema["vec_id"], vectors.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    return vectors.mapInArrow(codes, fields)


def decode(codes: DataFrame, books: Books, dim: int, scale: int = SCALE) -> DataFrame:
    """Adds vector, the middle of the cells that the entries stand for, to codes of vectors of one size."""
    book = codes.sparkSession.sparkContext.broadcast((books[dim] + 0.5) / scale)
    digits = max(2, len(f"{books[dim].shape[1] - 1:x}"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("code").to_pylist()
            rows = [np.concatenate([book.value[p, int(c[p * digits : p * digits + digits], 16)] for p in range(len(book.value))])[:dim].tolist() for c in code]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.mapInArrow(vectors, StructType([*codes.schema.fields, *codes.sparkSession.createDataFrame([], "vector array<double>").schema.fields]))


def compress(frame: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error, label_error of each row that takes part; the codebooks).

    Rows whose vector is null or holds null or non-finite components are dropped; rows with a null id stay. Vectors of
    other sizes have codebooks of their own; sizes that `parts` does not divide are filled with zeros, empty vectors have
    code 0 and error 0. Components beyond LARGEST / scale are taken as that. label_error is summed over equal labels,
    nulls together, in SALTS parts per label. Other columns are left out; an empty table gives none.
    """
    vectors = saved(integers(frame, scale), "code-integers")
    books = fit(vectors, parts, entries, rounds)
    codes = saved(encode(vectors, books, parts).withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))), "codes")
    by_salt = saved(codes.groupBy("label", "salt").agg(F.sum("error").alias("part_error")), "code-errors")
    by_label = by_salt.groupBy(F.col("label").alias("of")).agg(F.sum("part_error").alias("label_error"))
    salted = by_salt.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("of", F.col("salt").alias("of_salt"), "label_error")
    met = codes.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    return met.select("vec_id", "label", "code", "error", "label_error"), books
