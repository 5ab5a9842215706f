"""Shared pieces: whole-batch text access in numpy, hashes, ranges, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text worked on at once inside a Python worker; one longer document makes a slice of its own.
SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where the session has none and all of it runs on one machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/quillspark-checkpoints"


def _hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder as compressed Parquet and read it back: later uses do not recompute it.

    The table lies in a folder of the application and is deleted when the application ends, or earlier by forget().
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/quillspark-{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, files = _hadoop_path(spark, folder)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def forget(table_: DataFrame) -> None:
    """Deletes a table of saved() that nothing reads any more."""
    where, files = _hadoop_path(table_.sparkSession, table_._saved_path)
    files.delete(where, True)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column with nulls as empty texts; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes in the column, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All indexes of the ranges, one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(total)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(seed: int) -> tuple[np.ndarray, np.uint64]:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return values, np.uint64(mix64(np.array([seed + 77], np.uint64))[0] | np.uint64(1))


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (runs without ASCII white space) of all texts, and the first word of each text."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z folded first if lower)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values, step = _tables(seed)
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    lengths = ends - starts
    longest = int(lengths.max())
    powers = np.full(longest, step, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    at = ranges(starts, lengths)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = values[raw[at]] * powers[place]
    sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the `size` words from each position on; positions too near the end hold no gram."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    step = _tables(seed)[1]
    out = np.zeros(n, np.uint64)
    # powers of two of the window are combined, so a gram costs log(size) passes
    block, width, at, scale = words.astype(np.uint64), 1, 0, np.uint64(1)
    left = size
    power = step
    while left:
        if left & 1:
            out += block[at : at + n] * scale
            with np.errstate(over="ignore"):
                scale = np.uint64(scale * power)
            at += width
        left >>= 1
        if left:
            block = block[: len(block) - width] + block[width:] * power
            with np.errstate(over="ignore"):
                power = np.uint64(power * power)
            width *= 2
    return mix64(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:n], out[width - have : width - have + n])
