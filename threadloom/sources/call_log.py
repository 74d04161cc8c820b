"""The call-log format: flat records of messages, reasoning, calls and results, timed in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CALL_LOG_ERROR, CALL_LOG_FINE, CALL_LOG_INJECTED, CALL_LOG_PATH_KEYS, CALL_LOG_TOOLS, COMMAND_KEYS
from ..functions import text as X
from ..functions import variants as V
from ..operators.classify import looked_up
from .events import counted, event, first_of, numbered, records_of, with_calls
from .rollout import OUTPUT_LIMIT, TEXT_LIMIT, injected

AGENT = "workbuddy"


def own_query(text: Column) -> Column:
    """What the user typed, out of what a harness wrapped around it, or null."""
    return F.nullif(X.strip(F.regexp_extract(text, "(?s)<user_query>(.*?)</user_query>", 1)), F.lit(""))


def staged(records: DataFrame) -> DataFrame:
    """session_id, seq, ts, v, outer (the record's type) and what is read out of it; skipped: why it gives no event, or null."""
    v, outer, said = F.col("v"), F.col("outer"), F.col("said")
    stamp = F.coalesce(X.epoch_time(V.at(v, "$.timestamp", "double")), X.iso_time(V.string(v, "$.timestamp")))
    rows = records_of(records).select(
        "session_id", "seq", "v", V.string(v, "$.type").alias("outer"), stamp.alias("ts"), F.coalesce(V.at(v, "$.id", "string"), F.col("seq").cast("string")).alias("id"),
        F.lower(F.coalesce(V.string(v, "$.role"), F.lit(""))).alias("role"), X.strip(V.joined(v, "$.content")).alias("said"),
    )
    rows = rows.withColumn("query", own_query(said))
    rows = rows.withColumn("wrapped", F.col("query").isNull() & injected(said, CALL_LOG_INJECTED))
    skipped = (
        F.when(outer.isNull(), "<no-type>")
        .when((outer == "message") & (said != "") & (F.col("role") == "user") & F.col("wrapped"), "injected")
        .when(~outer.isin("message", "reasoning", "function_call", "function_call_result"), outer)
    )
    return rows.withColumn("skipped", skipped)


def call_log_events(records: DataFrame) -> DataFrame:
    """records(session_id, seq, record, is_error) as events."""
    v, outer, said, id_, role = (F.col(c) for c in ("v", "outer", "said", "id", "role"))
    given = V.at(v, "$.arguments")
    rows = staged(records).withColumns(
        {
            "thought": F.coalesce(F.nullif(F.array_join(V.texts(v, "$.rawContent", plain=False), "\n"), F.lit("")), said),
            "args": V.arguments(given),
            "raw": F.coalesce(V.string(given), F.to_json(given), F.lit("")),
            "tool": F.coalesce(V.filled(v, "$.name"), F.lit("unknown_tool")),
            "status": F.lower(F.coalesce(V.string(v, "$.status"), F.lit(""))),
            "output": X.strip(V.joined(v, "$.output")),
        }
    )
    failed = ~F.col("status").isin("", *CALL_LOG_FINE) | F.rlike(F.left("output", F.lit(600)), F.lit(CALL_LOG_ERROR))
    rows = rows.withColumns({"failed": failed, "cut": X.truncate(F.col("output"), OUTPUT_LIMIT)})
    user = event(ordinal=id_, type="user_message", role="user", content=F.coalesce("query", said), kind="user_message", significance=3)
    reply = event(ordinal=id_, type="assistant_message", role="assistant", content=said, kind="assistant_message", significance=2)
    reasoning = event(ordinal=id_, type="reasoning", role="assistant", content=X.truncate(F.col("thought"), TEXT_LIMIT), kind="reasoning", significance=1)
    call = event(
        ordinal=id_, type="tool_call", role="assistant", content=X.truncate(F.col("raw"), TEXT_LIMIT), tool_name=F.col("tool"),
        command=V.first_filled(F.col("args"), COMMAND_KEYS, X.strip), call_id=F.coalesce(V.filled(v, "$.callId"), id_), kind="tool_call",
        paths=V.all_filled(F.col("args"), CALL_LOG_PATH_KEYS, X.strip), category_hint=looked_up(F.col("tool"), CALL_LOG_TOOLS), significance=2,
    )
    result = event(
        ordinal=id_, type="tool_result", role="tool", content=F.col("cut"), result=F.col("cut"), tool_name=V.string(v, "$.name"), call_id=V.filled(v, "$.callId"),
        kind="tool_output", is_failure=F.col("failed"), reason=F.nullif(F.col("status"), F.lit("")), significance=F.when(F.col("failed"), 2).otherwise(1),
    )
    made = (
        F.when(F.col("skipped").isNotNull(), None)
        .when((outer == "message") & (said != "") & (role == "user"), user)
        .when((outer == "message") & (said != "") & (role == "assistant"), reply)
        .when((outer == "reasoning") & (F.col("thought") != ""), reasoning)
        .when(outer == "function_call", call)
        .when(outer == "function_call_result", result)
    )
    return with_calls(numbered(rows.select("session_id", "seq", F.lit(0).alias("place"), "ts", made.alias("e")), AGENT))


def call_log_counters(records: DataFrame) -> DataFrame:
    return counted(staged(records))


def call_log_sessions(records: DataFrame) -> DataFrame:
    """One row per session: the first folder and model, and the last id, that its records name."""
    rows, v = records_of(records).filter(V.string(F.col("v"), "$.type").isNotNull()), F.col("v")
    return rows.groupBy("session_id").agg(
        first_of(V.filled(v, "$.cwd")).alias("cwd"),
        F.max_by(V.filled(v, "$.sessionId"), F.when(V.filled(v, "$.sessionId").isNotNull(), F.col("seq"))).alias("stated_id"),
        first_of(V.filled(v, "$.providerData.model")).alias("model"),
    )
