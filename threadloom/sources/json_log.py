"""Reader of logs that hold JSON values one after another, also over several lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .log_source import SCHEMA, SPLIT_BYTES, _open, batches, log_values, scan


def log_files(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl") -> DataFrame:
    """The files of a format below the paths, without their contents: path, modified, size, name, session key, archived."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.jsonl$", "")
    key = F.nullif(F.regexp_extract(name, r"^rollout-.*?([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl$", 1), F.lit(""))
    return files.select(
        "path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), name.alias("name"), F.coalesce(key, stem).alias("session_id"),
        F.contains("path", F.lit("/archived_sessions/")).alias("archived"),
    )


def newest_first(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """Sessions by their last change, before anything of them is read."""
    ordered = listing.orderBy(F.desc("modified"), "path")
    return ordered if limit is None else ordered.limit(limit)


def find_session(listing: DataFrame, wanted: str) -> DataFrame:
    """The file of a session: that named so, else the first whose name contains it, by path."""
    rank = F.when(F.col("session_id") == wanted, 0).when(F.contains("name", F.lit(wanted)), 1)
    return listing.withColumn("rank", rank).filter("rank is not null").orderBy("rank", "path").limit(1).drop("rank")


def read_json_log(spark: SparkSession, path: str | list[str], max_bytes: int | None = None, pattern: str = "*.jsonl", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, seq, record (a JSON object as text, for parse_json), is_error: the values of all logs, a task for each split_bytes.

    max_bytes reads only the start of each file, for listings.  Unreadable records stay as marked rows, as do those that
    nest too deep for the parser; halves of surrogate pairs become U+FFFD, numbers beyond the range of doubles null.  In
    stores that pyarrow doesn't know Spark reads the files, and a task takes a whole one.
    """
    paths = [path] if isinstance(path, str) else list(path)
    try:
        for p in paths:
            _open(p)
    except (ValueError, pa.ArrowException, OSError, ImportError):
        return whole_logs(spark, paths, max_bytes, pattern)
    return log_values(spark, paths, max_bytes, pattern, split_bytes)


def whole_logs(spark: SparkSession, path: list[str], max_bytes: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """The rows of read_json_log, from files that Spark hands over whole."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for file, data in zip(part.column("path").to_pylist(), part.column("content")):
                held = data.as_py()
                values = scan(lambda at, n, held=held: held[at : at + n], 0, len(held), len(held))
                next(values)
                yield from batches(file, 0, ((record, bad) for _, record, bad in values))

    return files.select("path", content.alias("content")).mapInArrow(run, SCHEMA)


def records_by_session(records: DataFrame, files: DataFrame) -> DataFrame:
    """read_json_log's rows as the parsers take them: session_id, seq, record, is_error, with the session that the file is named after."""
    named = files.select("path", "session_id")
    return records.join(named, "path").select("session_id", "seq", "record", "is_error")


def listing(files: DataFrame, sessions: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The files with what their sessions say; the number of records and of user messages are null, not 0, unless they were counted."""
    rows = files.join(sessions, "session_id", "left")
    if counts is None:
        return rows.select("*", F.lit(None).cast("long").alias("n_records"), F.lit(None).cast("long").alias("n_user"))
    return rows.join(counts.select("session_id", "n_records", "n_user"), "session_id", "left")
