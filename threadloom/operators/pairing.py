"""Joins of tool calls with their results, and of failures with what came later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import united
from ..sources.events import CALL, FIELDS, RESULT, unmatched, with_calls


def with_call_seq(events: DataFrame) -> DataFrame:
    """events(session_id, seq, kind call or result, call_id) with call_seq, as the formats' own events are paired.

    An event without an id is never paired.
    """
    none = {c: F.lit(None).cast(FIELDS[c]) for c in ("tool_name", "command", "paths")}
    shaped = events.withColumns({"type": F.when(F.col("kind") == "call", CALL).otherwise(RESULT), "own_id": F.col("call_id"), "call_id": F.col("call_id").cast("string")} | none)
    return with_calls(shaped).withColumn("call_id", F.col("own_id")).select(*events.columns, "type", "call_seq")


def pair_calls(events: DataFrame) -> DataFrame:
    """Per call its last result, and orphaned results as rows of their own: session_id, seq, call_id, n_results, result_seq, value."""
    seen = with_call_seq(events)
    results = (
        seen.filter("call_seq is not null")
        .groupBy("session_id", F.col("call_seq").alias("seq"))
        .agg(F.count(F.lit(1)).alias("n_results"), F.max_by(F.struct("seq", "value"), "seq").alias("r"))
    )
    calls = seen.filter("kind = 'call'").select("session_id", "seq", "call_id").join(results, ["session_id", "seq"], "left")
    paired = calls.select("session_id", "seq", "call_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("r.seq").alias("result_seq"), F.col("r.value").alias("value"))
    orphans = seen.filter("kind = 'result' and call_seq is null").select(
        "session_id", "seq", "call_id", F.lit(0).cast("long").alias("n_results"), F.col("seq").alias("result_seq"), "value"
    )
    return united(paired, orphans)


def unmatched_results(events: DataFrame) -> DataFrame:
    return unmatched(with_call_seq(events))


def resolved_later(events: DataFrame) -> DataFrame:
    """Failures with `resolved`: the same command succeeded at a strictly later time.  The later side is one row per command."""
    key = F.trim("command").alias("key")
    last = events.filter("not is_failure").groupBy("session_id", key).agg(F.max("ts").alias("last_ok"))
    failed = events.filter("is_failure").withColumn("key", key)
    return failed.join(last, ["session_id", "key"], "left").withColumn("resolved", F.coalesce(F.col("last_ok") > F.col("ts"), F.lit(False))).drop("key", "last_ok")


def same_error(events: DataFrame, others: int = 2) -> DataFrame:
    """Failures whose error line at least `others` other failures of the session share."""
    failed = events.filter("is_failure")
    counts = failed.groupBy("session_id", "error").agg((F.count(F.lit(1)) - 1).alias("n_others")).filter(F.col("n_others") >= others)
    return failed.join(counts, ["session_id", "error"])


def missing_references(claimed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return claimed.join(present.select(key).distinct(), key, "left_anti")


def migration_pairs(agents: DataFrame) -> DataFrame:
    """Each ordered pair of two different agents.  agents is a table of a few rows."""
    return agents.select(F.col("agent").alias("source")).join(agents.select(F.col("agent").alias("target")), F.col("source") != F.col("target"))
