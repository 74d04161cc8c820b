"""The event table that every log format is parsed into, and what all formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a parser says of an event, besides session_id and seq.  files: distinct paths of a patch with its statistics.
FIELDS = {
    "ordinal": "string", "type": "string", "role": "string", "content": "string", "tool_name": "string", "command": "string", "result": "string",
    "call_id": "string", "kind": "string", "paths": "array<string>",
    "files": "array<struct<path:string,status:string,hunks:int,added:int,removed:int>>",
    "category_hint": "string", "exit_code": "int", "is_failure": "boolean", "reason": "string", "significance": "int",
}
EVENT = "struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">"
CALL, RESULT = "tool_call", "tool_result"


def event(**fields: Column | str | int) -> Column:
    """One event as a struct; what isn't named is null."""
    value = lambda n: fields[n] if isinstance(fields.get(n), Column) else F.lit(fields.get(n))
    return F.struct(*[value(n).cast(t).alias(n) for n, t in FIELDS.items()])


def records_of(records: DataFrame) -> DataFrame:
    """records(session_id, seq, record, is_error) that could be read, with `v`, the record as a variant."""
    return records.filter(~F.coalesce("is_error", F.lit(False))).select("session_id", "seq", F.try_parse_json("record").alias("v"))


def numbered(rows: DataFrame, agent: str) -> DataFrame:
    """rows(session_id, seq, place, ts, e) to one event per row that has one; its seq is the record's times 1000 with the place in it.

    Rows without one go by an explode of an expression: a filter, or what is inferred from an exploded column, would be
    pushed below the projections that e is made in, with all their expressions.
    """
    return rows.select("session_id", "seq", "place", "ts", F.explode(F.array_compact(F.array("e"))).alias("e")).select(
        F.lit(agent).alias("agent"),
        "session_id",
        (F.col("seq") * 1000 + F.col("place")).cast("long").alias("seq"),
        F.concat_ws(":", F.lit(agent), F.coalesce("e.ordinal", F.lit("None")), "e.type").alias("event_id"),
        "ts",
        "e.*",
    )


def with_calls(events: DataFrame) -> DataFrame:
    """events with call_seq: for a result, the latest earlier call of its id, whose tool, command and paths it takes over.

    Calls and results meet by session and id; any other row is a group of its own, so none of them gathers.
    """
    paired = F.col("type").isin(CALL, RESULT) & (F.coalesce("call_id", F.lit("")) != "")
    group = F.when(paired, F.concat(F.lit("="), "call_id")).otherwise(F.col("seq").cast("string"))
    before = W.partitionBy("session_id", "group").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    call = F.last(F.when(F.col("type") == CALL, F.struct("seq", "tool_name", "command", "paths")), ignorenulls=True).over(before)
    seen = events.withColumn("group", group).withColumn("call", F.when(F.col("type") == RESULT, call))
    own = {c: F.coalesce(F.col(f"call.{c}"), F.col(c)).alias(c) for c in ("tool_name", "command", "paths")}
    return seen.select(*[own.get(c, F.col(c)) for c in events.columns], F.col("call.seq").alias("call_seq"))


def unmatched(events: DataFrame) -> DataFrame:
    """Per session the number of results without a call."""
    return events.filter((F.col("type") == RESULT) & F.col("call_seq").isNull()).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_unmatched"))


def counted(parsed: DataFrame, reasons: str = "skipped") -> DataFrame:
    """Per session: records, used, and a map of how often each reason was given for skipping one."""
    one = parsed.groupBy("session_id", reasons).agg(F.count(F.lit(1)).alias("n"))
    entry = F.when(F.col(reasons).isNotNull(), F.struct(F.col(reasons).alias("key"), F.col("n").alias("value")))
    return one.groupBy("session_id").agg(
        F.sum("n").alias("n_records"),
        F.coalesce(F.sum(F.when(F.col(reasons).isNull(), F.col("n"))), F.lit(0)).alias("n_used"),
        F.map_from_entries(F.array_compact(F.array_sort(F.collect_list(entry)))).alias("skipped"),
    )


def last_of(value: Column) -> Column:
    """Of the rows where it isn't null, the last value by seq, as an aggregate."""
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def first_of(value: Column) -> Column:
    return F.min_by(value, F.when(value.isNotNull(), F.col("seq")))
