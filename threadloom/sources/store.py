"""Snapshots, documents and ledgers as tables: written by Spark, listed newest first, looked up by key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import redact

#: Encodings that a text is tried in; the last one reads anything.
ENCODINGS = ("utf-8", "gbk", "latin-1")


def save_snapshot(records: DataFrame, path: str, mode: str = "balanced") -> None:
    """records(agent, session_id, seq, record, is_error) with their values masked, by agent; the session is a safe name of its id."""
    masked = F.when(F.col("record").isNotNull(), redact.redact_json(F.col("record"), mode))
    rows = records.withColumns({"record": masked, "session_id": X.safe_name(F.col("session_id"))})
    rows.write.mode("append").partitionBy("agent").parquet(path)


def snapshot(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """The records of a snapshot; `most` keeps the first of each session, for reports."""
    rows = spark.read.parquet(path)
    if most is None:
        return rows
    nth = F.row_number().over(W.partitionBy("agent", "session_id").orderBy("seq"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).drop("nth")


def save_documents(documents: DataFrame, path: str, mode: str = "balanced") -> None:
    """documents(memory_id, session_id, created, ..., markdown) as masked JSON beside their Markdown, one row per document."""
    body = F.to_json(F.struct(*[c for c in documents.columns if c not in ("memory_id", "created", "markdown")]))
    json, markdown = redact.redact_json(body, mode), redact.masked(X.text_of(F.col("markdown")), redact.secret_spans(X.text_of(F.col("markdown"))), mode)
    rows = documents.select("memory_id", F.col("session_id").cast("string").alias("session_id"), "created", json.alias("document"), markdown.alias("markdown"))
    rows.withColumn("size", F.octet_length("document").cast("long")).write.mode("append").parquet(path)


def catalogue(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The newest documents, without their bodies: memory_id, source_agent, session_id, title, status, path, created, size.

    A document that can't be read as JSON is left out.
    """
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("path"), F.try_parse_json("document").alias("d")).filter("d is not null")
    field = lambda p: F.try_variant_get("d", p, "string")
    return rows.orderBy(F.desc("created"), "memory_id").limit(limit).select(
        "memory_id", field("$.metadata.source_agent").alias("source_agent"), "session_id", field("$.task.title").alias("title"), field("$.task.status").alias("status"), "path", "created", "size"
    )


def document(spark: SparkSession, path: str, memory_id: str, must_exist: bool = False) -> DataFrame:
    """The document of an id, or no row; with must_exist an id that isn't there is an error."""
    found = spark.read.parquet(path).filter(F.col("memory_id") == memory_id)
    if must_exist and found.isEmpty():
        raise LookupError(f"no document {memory_id}")
    return found


def save_ledger(steps: DataFrame, path: str) -> None:
    """steps(run_id, seq, state, started, ended, detail) of runs, appended."""
    took = F.when(F.col("ended").isNotNull(), F.unix_millis("ended") - F.unix_millis("started"))
    steps.withColumn("duration_ms", took).write.mode("append").parquet(path)


def ledger(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """The latest runs with the state that they ended in and how long their steps took."""
    rows = spark.read.parquet(path).groupBy("run_id").agg(
        F.min("started").alias("started"), F.max_by("state", "seq").alias("state"), F.sum("duration_ms").alias("duration_ms"), F.count(F.lit(1)).alias("n_steps")
    )
    return rows.orderBy(F.desc("started"), "run_id").limit(limit)


def read_texts(spark: SparkSession, path: str, pattern: str = "*", limit: int = 20_000) -> DataFrame:
    """path, text of files in any of ENCODINGS, the first that fits the bytes; at most `limit` characters, a file in a row."""

    def decode(data: bytes) -> str:
        for name in ENCODINGS:
            try:
                return bytes(data).decode(name).removeprefix("﻿")[:limit]
            except UnicodeDecodeError:
                continue
        return ""

    def run(contents: pd.Series) -> pd.Series:
        return contents.map(decode)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.pandas_udf(run, "string")("content").alias("text"))


def status_lines(c: Column) -> Column:
    """The lines of a short version-control status, as struct(code, path, untracked): the target of a rename, without quotes."""
    told = F.filter(X.lines(c), lambda x: X.strip(x) != "")

    def one(line: Column) -> Column:
        rest = X.strip(F.substring(line, F.lit(4), F.length(line)))
        path = F.when(F.contains(rest, F.lit(" -> ")), X.strip(F.substring(rest, F.instr(rest, F.lit(" -> ")) + 4, F.length(rest)))).otherwise(rest)
        code = F.left(line, F.lit(2))
        return F.struct(code.alias("code"), F.regexp_replace(path, '^"+|"+$', "").alias("path"), (X.strip(code) == "??").alias("untracked"))

    return F.transform(told, one)
