"""Line dedup with DataFrame functions alone: a line that several documents hold stays in the first of them.

Only 128-bit hashes of lines travel; they are computed once and written. They are pre-aggregated (a hash keeps at most
SALTS rows, however many documents hold it), range-partitioned and sorted by hash and first document; the first row of
each hash names the document that keeps the line, and all its rows carry that name back, so that the lines of a frequent
hash are met in SALTS parts. What comes back per document is its keep bitmap, compressed to runs of kept lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import saved

LEAST_CHARS = 10
SALTS = 32
#: White space that is stripped around a line: fixed values.
BLANK = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space around it and with A-Z in lower case; other letters stay as they are."""
    stripped = F.btrim(line, F.lit(BLANK))
    return F.when(F.length(stripped) == F.octet_length(stripped), F.lower(stripped)).otherwise(F.translate(stripped, _UPPER, _LOWER))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def keep_runs(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text_hash, keep: for rows that lose lines, the runs (start from 1, size) of the lines that stay, in order.

    The last run is open. Two rows of the same doc_id are one document; text_hash tells them apart.
    """
    texts = _texts(docs).where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    lines = texts.select("doc_id", "text_hash", F.posexplode_outer(F.split("text", "\n", -1)).alias("at", "line"))  # outer: else Spark splits twice
    keys = lines.select("doc_id", "text_hash", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= least_chars)
    hashes = F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")
    hashed = saved(keys.select("doc_id", "text_hash", "at", *hashes, F.pmod("doc_id", F.lit(SALTS)).alias("salt")), "line-hashes")
    counted = hashed.groupBy("h1", "h2", "salt").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    ranged = counted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "first")
    run = Window.partitionBy("h1", "h2").orderBy("first")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = ranged.select("h1", "h2", "salt", F.first("first").over(whole).alias("first"), F.max("last").over(whole).alias("last"))
    dropped = hashed.join(firsts.where("last > first").drop("last"), ["h1", "h2", "salt"]).where("doc_id > first")
    places = F.array_sort(F.collect_list("at"))
    listed = dropped.groupBy("doc_id", "text_hash").agg(places.alias("places"))
    between = F.zip_with(F.concat(F.array(F.lit(-1)), "places"), F.concat("places", F.array(F.lit(2**31 - 1))), lambda a, b: F.struct((a + 2).alias("start"), (b - a - 1).alias("size")))
    return listed.select("doc_id", "text_hash", F.filter(between, lambda r: r["size"] > 0).alias("keep"))


def _kept(lines: str, keep: str) -> Column:
    return F.flatten(F.transform(keep, lambda r: F.slice(lines, r["start"], F.least(r["size"], F.size(lines)))))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the kept lines) of each row.

    A null or empty text is one empty line. Rows with a null doc_id keep all their lines and take no part. Repeated
    rows get the same result. Other columns are left out, so their names cannot clash; an empty table gives none.
    """
    keep = keep_runs(docs, least_chars)
    joined = _texts(docs).withColumn("text_hash", F.xxhash64("text")).join(keep, ["doc_id", "text_hash"], "left")
    parts = joined.select("doc_id", F.split("text", "\n", -1).alias("lines"), "keep").select("doc_id", F.size("lines").alias("n"), F.when(F.col("keep").isNull(), F.col("lines")).otherwise(_kept("lines", "keep")).alias("kept"))
    return parts.select("doc_id", F.col("n").cast("long").alias("n_lines"), (F.col("n") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the kept lines as text; all rows and columns stay, n_chars follows the text, rows without a dropped line are untouched."""
    # the row is one column, so that none of its names can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    field = lambda c: F.col("row").getField(c)
    rows = rows.select("row", field("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(field("text").cast("string"), F.lit(""))).alias("text_hash"))
    joined = rows.join(keep_runs(docs, least_chars), ["doc_id", "text_hash"], "left")
    joined = joined.withColumn("lines", F.when(F.col("keep").isNotNull(), F.split(field("text"), "\n", -1)))
    joined = joined.withColumn("text", F.when(F.col("keep").isNull(), field("text")).otherwise(F.array_join(_kept("lines", "keep"), "\n")))
    out = {c: field(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("keep").isNull(), out["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*(v.alias(c) for c, v in out.items()))
