"""The project-log format: records with a message of content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import (
    API_ERROR, COMMAND_KEYS, LABEL, PROJECT_LOG_BOOKKEEPING, PROJECT_LOG_ERROR, PROJECT_LOG_EXIT, PROJECT_LOG_INJECTED, PROJECT_LOG_PATH_KEYS,
    PROJECT_LOG_TOOLS,
)
from ..functions import text as X
from ..functions import variants as V
from ..operators.classify import looked_up
from .events import counted, event, last_of, numbered, records_of, with_calls
from .rollout import OUTPUT_LIMIT, TEXT_LIMIT, injected

AGENT = "claude"


def stated_exit(is_error: Column, outcome: Column, output: Column) -> Column:
    """The exit code of a result: from its outcome's fields, an interrupt, its error stream, its text, or that it is an error."""
    numbers = [F.when(V.kind_of(V.at(outcome, f"$.{k}")) == "BIGINT", V.at(outcome, f"$.{k}", "int")) for k in ("exitCode", "exit_code", "code")]
    return F.coalesce(
        *numbers,
        F.when(V.truthy(outcome, "$.interrupted"), 130),
        F.when(is_error & (X.strip(V.string(outcome, "$.stderr")) != ""), 1),
        F.nullif(F.regexp_extract(output, PROJECT_LOG_EXIT, 1), F.lit("")).try_cast("int"),
        F.when(is_error, 1),
    )


def staged(records: DataFrame) -> DataFrame:
    """session_id, seq, ts, v, outer (the record's type) and what is read out of it; skipped: why it gives no event, or null."""
    v, outer = F.col("v"), F.col("outer")
    kind = lambda b: F.coalesce(V.string(b, "$.type"), F.lit(""))
    rows = records_of(records).select(
        "session_id", "seq", "v", V.string(v, "$.type").alias("outer"), X.iso_time(V.string(v, "$.timestamp")).alias("ts"),
        F.coalesce(V.filled(v, "$.uuid"), F.col("seq").cast("string")).alias("uuid"), V.at(v, "$.message").alias("message"),
        V.truthy(v, "$.isSidechain").alias("side"),
    )
    rows = rows.withColumns({"own": V.string(F.col("message"), "$.content"), "content": V.items(F.col("message"), "$.content"), "known": V.is_object(F.col("message"))})
    rows = rows.withColumns(
        {
            "has_results": F.exists("content", lambda b: kind(b) == "tool_result"),
            "texts": F.when(F.col("own").isNotNull(), F.array("own")).otherwise(
                F.filter(F.transform("content", lambda b: F.when(kind(b) == "text", V.filled(b, "$.text"))), lambda t: t.isNotNull())
            ),
        }
    )
    rows = rows.withColumns({"asked": X.strip(F.array_join("texts", "\n")), "replies": F.filter(F.transform("texts", X.strip), lambda t: t != "")})
    rows = rows.withColumns(
        {
            "harness": V.truthy(v, "$.isMeta") | injected(F.col("asked"), PROJECT_LOG_INJECTED, 300),
            "is_api": V.truthy(v, "$.isApiErrorMessage") | F.coalesce(F.rlike(F.left(F.get("replies", F.lit(0)), F.lit(200)), F.lit(API_ERROR)), F.lit(False)),
        }
    )
    skipped = (
        F.when(outer.isNull(), "<no-type>")
        .when(F.col("side"), "sidechain")
        .when((outer == "user") & F.col("known") & ~F.col("has_results") & (F.col("asked") != "") & F.col("harness"), "injected")
        .when(outer == "system", F.concat(F.lit("system/"), F.coalesce(V.string(v, "$.subtype"), F.lit("None"))))
        .when(~outer.isin("summary", "user", "assistant"), outer)
    )
    return rows.withColumn("skipped", skipped)


def project_log_events(records: DataFrame) -> DataFrame:
    """records(session_id, seq, record, is_error) as events.

    A record's own event, such as a reply's joined texts, has the first place in it, and each block the place after its
    own; a record of an API error is that error alone.
    """
    v, outer, uuid, b = F.col("v"), F.col("outer"), F.col("uuid"), F.col("b")
    none = F.lit(None).cast("variant")
    blocks = F.when(F.col("known") & ~F.col("is_api"), F.concat(F.array(none), F.col("content"))).otherwise(F.array(none))
    rows = staged(records).select("*", F.posexplode(blocks).alias("place", "b"))
    rows = rows.withColumns(
        {
            "block": F.coalesce(V.string(b, "$.type"), F.lit("")),
            "call_id": F.coalesce(V.string(b, "$.tool_use_id"), V.string(b, "$.id"), F.lit("")),
            "output": V.joined(b, "$.content"),
            "marked": V.truthy(b, "$.is_error"),
            "args": F.when(V.is_object(V.at(b, "$.input")), V.at(b, "$.input")),
            "tool": F.coalesce(V.filled(b, "$.name"), F.lit("unknown_tool")),
            "thought": X.strip(V.string(b, "$.thinking")),
        }
    )
    rows = rows.withColumns({"code": stated_exit(F.col("marked"), V.at(v, "$.toolUseResult"), F.col("output")), "cut": X.truncate(F.col("output"), OUTPUT_LIMIT)})
    rows = rows.withColumn("failed", F.col("marked") | (F.col("code").isNull() & F.rlike(F.left("output", F.lit(600)), F.lit(PROJECT_LOG_ERROR))))
    own_id = F.concat(uuid, F.lit(":"), F.right("call_id", F.lit(8)))
    call_id = F.nullif(F.col("call_id"), F.lit(""))
    result = event(
        ordinal=own_id, type="tool_result", role="tool", content=F.col("cut"), result=F.col("cut"), call_id=call_id, kind="tool_output",
        exit_code=F.col("code"), is_failure=F.col("failed"), significance=F.when(F.col("failed"), 2).otherwise(1),
    )
    call = event(
        ordinal=F.when(call_id.isNotNull(), own_id).otherwise(uuid), type="tool_call", role="assistant", tool_name=F.col("tool"), call_id=call_id, kind="tool_call",
        content=X.truncate(F.coalesce(F.to_json("args"), F.lit("{}")), TEXT_LIMIT), command=V.first_filled(F.col("args"), COMMAND_KEYS, X.strip),
        paths=V.all_filled(F.col("args"), PROJECT_LOG_PATH_KEYS, X.strip), category_hint=looked_up(F.col("tool"), PROJECT_LOG_TOOLS), significance=2,
    )
    thinking = event(ordinal=F.concat(uuid, F.lit(":thinking")), type="reasoning", role="assistant", content=X.truncate(F.col("thought"), TEXT_LIMIT), kind="thinking", significance=1)
    body = F.array_join("replies", "\n\n")
    said = F.coalesce(F.nullif(body, F.lit("")), V.filled(v, "$.error"), F.lit(LABEL["api_failed"]))
    summary = event(ordinal=uuid, type="session_meta", content=F.left(F.coalesce(V.string(v, "$.summary"), F.lit("")), F.lit(2000)), kind="summary", significance=3)
    user = event(ordinal=uuid, type="user_message", role="user", content=F.col("asked"), kind="user_message", significance=3)
    api = event(ordinal=uuid, type="error", role="assistant", content=X.truncate(said, 2000), kind="api_error", reason=V.string(v, "$.error"), significance=3)
    reply = event(ordinal=uuid, type="assistant_message", role="assistant", content=body, kind="assistant_message", significance=2)
    is_user, is_reply, first = (outer == "user") & F.col("known"), (outer == "assistant") & F.col("known"), F.col("place") == 0
    made = (
        F.when(F.col("skipped").isNotNull(), None)
        .when(first & (outer == "summary"), summary)
        .when(first & is_user & ~F.col("has_results") & (F.col("asked") != ""), user)
        .when(first & is_reply & F.col("is_api"), api)
        .when(first & is_reply & (F.size("replies") > 0), reply)
        .when(is_user & (F.col("block") == "tool_result"), result)
        .when(is_reply & (F.col("block") == "tool_use"), call)
        .when(is_reply & (F.col("block") == "thinking") & (F.col("thought") != ""), thinking)
    )
    return with_calls(numbered(rows.select("session_id", "seq", "place", "ts", made.alias("e")), AGENT))


def project_log_counters(records: DataFrame) -> DataFrame:
    return counted(staged(records))


def project_log_sessions(records: DataFrame) -> DataFrame:
    """One row per session: the last of each field that isn't empty; side chains don't count."""
    rows = records_of(records).filter(V.string(F.col("v"), "$.type").isNotNull() & ~V.truthy(F.col("v"), "$.isSidechain"))
    v = F.col("v")
    own = last_of(V.filled(v, "$.cwd"))
    attached = F.when(V.string(v, "$.type") == "attachment", V.filled(v, "$.attachment.snapshot.workingDirectory"))
    cost = lambda name: last_of(F.when(V.string(v, "$.type") == "cost-state", V.at(v, f"$.{name}", "double")))
    return rows.groupBy("session_id").agg(
        F.coalesce(last_of(V.filled(v, "$.sessionId")), F.first("session_id")).alias("stated_id"),
        F.coalesce(own, F.min_by(attached, F.when(attached.isNotNull(), F.col("seq")))).alias("cwd"),
        last_of(V.filled(v, "$.version")).alias("cli_version"),
        last_of(V.filled(v, "$.gitBranch")).alias("git_branch"),
        last_of(V.filled(v, "$.entrypoint")).alias("entrypoint"),
        cost("totalLinesAdded").alias("lines_added"),
        cost("totalLinesRemoved").alias("lines_removed"),
        cost("totalCostUSD").alias("cost_usd"),
    )


#: Types of records that never become events.
BOOKKEEPING = [*PROJECT_LOG_BOOKKEEPING, "attachment"]
