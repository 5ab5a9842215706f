"""Readers, writers and caches of stage tables."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Size up to which a table of topics is sent to every task.
SMALL_ROWS, SMALL_BYTES = 10_000, 32 << 20


def small(frame: DataFrame, rows: int = SMALL_ROWS, most: int = SMALL_BYTES) -> DataFrame:
    """The table, computed once and sent to every task, if it has at most `rows` rows and `most` bytes; else as it is, for a shuffled join."""
    found = frame.limit(rows + 1).toArrow()
    if found.num_rows > rows or found.nbytes > most:
        return frame
    return F.broadcast(frame.sparkSession.createDataFrame(found, frame.schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """The table over all cores if its files make fewer parts than there are; filters and columns still reach the scan."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def load_reviews(frame: DataFrame, text: str = "review", label: str = "label", key: str = "doc_id", n: int | None = None, seed: int = 42) -> DataFrame:
    """doc_id, review, label; with n exactly n rows (or all, if fewer)."""
    out = frame.select(F.col(key).alias("doc_id"), F.col(text).alias("review"), F.col(label).alias("label"))
    return out if n is None else seeded_sample(out, n, seed)


def seeded_sample(frame: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """n rows by the order of a keyed hash: the same ones whatever the partitions."""
    return frame.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with a header, whose texts may hold line ends."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").csv(path, header=True, escape='"')


def write_parquet(frame: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    frame.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def _at(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one in the temporary folder only where the session has none and runs on one machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/quillspark-kept"


def kept(frame: DataFrame, label: str) -> DataFrame:
    """The table, written once to the shared folder and read again, so that later uses neither recompute it nor depend on an executor.

    It lies in a folder of the application, which is deleted when the application ends, or earlier by drop_kept().
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    where, files = _at(spark, folder)
    files.deleteOnExit(where)
    out = spark.read.schema(frame.schema).parquet(path)
    out._kept_path = path
    return out


def drop_kept(*frames: DataFrame) -> None:
    """Deletes tables of kept() that nothing reads any more."""
    for frame in frames:
        where, files = _at(frame.sparkSession, frame._kept_path)
        files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    where, files = _at(spark, path)
    return files.exists(where)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    (old, files), (new, _) = _at(spark, source), _at(spark, target)
    if not files.rename(old, new):
        raise OSError(f"{source} could not become {target}")


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def current_path(spark: SparkSession, path: str) -> str | None:
    """Where the last whole version of a table lies: at path, or beside it if replace_table() was stopped half-way."""
    if exists(spark, path):
        return path
    if exists(spark, f"{path}.new/_SUCCESS"):
        return f"{path}.new"
    return f"{path}.old" if exists(spark, f"{path}.old") else None


def _settle(spark: SparkSession, path: str) -> None:
    """Brings the last whole version to path and removes what a stopped replacement has left."""
    found = current_path(spark, path)
    if found is not None and found != path:
        _rename(spark, found, path)
    for rest in (f"{path}.new", f"{path}.old"):
        if exists(spark, rest):
            _delete(spark, rest)


def replace_table(frame: DataFrame, path: str) -> DataFrame:
    """Writes a table that may be made from the one at path: beside it first, then in its place.

    At every moment a whole version lies at path or where current_path() says; one that was stopped is finished, or
    taken back if it was not whole, by the next replacement.
    """
    spark = frame.sparkSession
    if current_path(spark, path) == path:  # else the frame may be made from what lies beside
        _settle(spark, path)
    beside = f"{path}.new" if current_path(spark, path) != f"{path}.new" else f"{path}.newer"
    write_parquet(frame, beside)
    if beside.endswith(".newer"):
        _settle(spark, path)
    if exists(spark, path):
        _rename(spark, path, f"{path}.old")
    _rename(spark, beside, path)
    _settle(spark, path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def append_table(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where, files = _at(spark, path)
    out = files.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_document(spark: SparkSession, path: str, document: dict[str, Any]) -> None:
    write_text(spark, path, json.dumps(document, ensure_ascii=False, indent=2, default=str))


def read_document(spark: SparkSession, path: str) -> dict[str, Any]:
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run the stage that writes it")
    return json.loads(spark.read.text(str(path), wholetext=True).first()[0])


def now_utc() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def load_or_compute(spark: SparkSession, path: str, settings: dict[str, Any], rows: int, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was made under equal settings and has `rows` rows; else it is computed and written.

    Settings lie in a one-row table beside it, so any store that Spark reaches will do.
    """
    wanted = json.dumps(settings, sort_keys=True)
    try:
        known = spark.read.json(f"{path}.settings").first()
        cached = spark.read.parquet(path)
        if known is not None and known["settings"] == wanted and cached.count() == rows:
            return cached
    except Exception as error:  # a missing path has no class of its own
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
    compute().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(wanted,)], "settings string").write.mode("overwrite").json(f"{path}.settings")
    return spark.read.parquet(path)


def append_run(runs: DataFrame, row: DataFrame) -> DataFrame:
    """The run log with one more row; columns are matched by name."""
    return runs.unionByName(row, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in the new batch, and the batch, by key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new).orderBy(*keys)


def latest(runs: DataFrame, tag: str = "tag", sequence: str = "seq") -> DataFrame:
    """The last row of each tag, by an explicit sequence column."""
    others = [c for c in runs.columns if c not in (tag, sequence)]
    return runs.groupBy(tag).agg(F.max_by(F.struct(sequence, *others), sequence).alias("r")).select(tag, "r.*")
