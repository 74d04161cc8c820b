"""The rollout format: records of {type, timestamp, ordinal, payload}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LABEL, PATCH_FILE, PATCH_MOVE, PATCH_STATUS, ROLLOUT_COMMAND_KEYS, ROLLOUT_INJECTED
from ..functions import text as X
from ..functions import variants as V
from .events import counted, event, first_of, last_of, numbered, records_of, with_calls

AGENT = "codex"
OUTPUT_LIMIT, TEXT_LIMIT = 6000, 4000


def injected(text: Column, markers: list[str] = ROLLOUT_INJECTED, within: int = 400) -> Column:
    """Whether a harness wrote the text: one of its markers stands near the beginning."""
    head = F.left(F.regexp_replace(text, f"^{X.SPACE}+", ""), F.lit(within))
    return F.rlike(head, F.lit(X.any_of(markers)))


def named_files(source: Column) -> Column:
    """The files that a patch names, in order: struct(path, status); nothing for a text without a patch."""
    status = F.create_map(*[F.lit(x) for pair in PATCH_STATUS.items() for x in pair])
    verbs, files = (F.regexp_extract_all(source, F.lit("(?m)" + PATCH_FILE), F.lit(g)) for g in (1, 2))
    moves = F.regexp_extract_all(source, F.lit("(?m)" + PATCH_MOVE), F.lit(1))
    listed = F.zip_with(verbs, files, lambda v, f: F.struct(f.alias("path"), F.element_at(status, v).alias("status")))
    moved = F.transform(moves, lambda m: F.struct(m.alias("path"), F.lit("modified").alias("status")))
    has = F.contains(source, F.lit("*** Begin Patch")) | F.contains(source, F.lit("*** Update File:"))
    return F.when(has, F.concat(listed, moved)).otherwise(F.array().cast("array<struct<path:string,status:string>>"))


def described(names: Column, stats: Column) -> Column:
    """Per distinct path of the named files: its last status, and its statistics where the patch has them."""
    last = lambda path: F.element_at(F.filter(names, lambda n: n["path"] == path), -1)["status"]
    of = lambda path, c: F.get(F.filter(stats, lambda s: s["path"] == path), F.lit(0))[c]
    each = F.array_distinct(F.transform(names, lambda n: n["path"]))
    return F.transform(each, lambda p: F.struct(p.alias("path"), last(p).alias("status"), *[of(p, c).alias(c) for c in ("hunks", "added", "removed")]))


def staged(records: DataFrame) -> DataFrame:
    """session_id, seq, ts, outer (the record's type), p (its payload, if it is an object), and what is read out of it.

    Every column is worked out once, in a projection of its own, before others are made from it.
    """
    v, p = F.col("v"), F.col("p")
    given = V.at(v, "$.payload")
    get = lambda name: V.string(p, f"$.{name}")
    there = lambda path: F.when(V.kind_of(V.at(p, path)) != "VOID", V.at(p, path))
    rows = records_of(records).select(
        "session_id", "seq", V.string(v, "$.type").alias("outer"), F.when(V.is_object(given), given).alias("p"),
        X.iso_time(V.string(v, "$.timestamp")).alias("ts"), V.at(v, "$.ordinal", "string").alias("ordinal"),
    )
    rows = rows.withColumns(
        {
            "item": get("type"), "role": F.lower(F.coalesce(get("role"), F.lit(""))), "said": X.strip(V.joined(p, "$.content")),
            "thought": X.strip(F.array_join(V.texts(p, "$.summary", plain=False), "\n")), "given": F.coalesce(there("$.arguments"), V.at(p, "$.input")),
            "out": F.coalesce(there("$.output"), V.at(p, "$.content")), "done": get("last_agent_message"),
        }
    )
    rows = rows.withColumns(
        {
            "raw": F.coalesce(V.string(F.col("given")), F.when(V.is_object(F.col("given")), F.to_json("given")), F.lit("")),
            "args": V.arguments(F.col("given")),
            "output": F.coalesce(V.string(F.col("out")), F.to_json("out"), F.lit("")),
            "is_injected": injected(F.col("said")),
        }
    )
    known = F.col("item").isin("message", "reasoning", "function_call", "custom_tool_call", "function_call_output", "custom_tool_call_output")
    item = F.coalesce("item", F.lit("None"))
    is_item, is_message, spoke = F.col("outer") == "response_item", (F.col("outer") == "response_item") & (F.col("item") == "message"), F.col("said") != ""
    role = F.when(F.col("role") == "", "unknown").otherwise(F.col("role"))
    skipped = (
        F.when(F.col("outer").isNull(), "<no-type>")
        .when(p.isNull() | ~F.col("outer").isin("session_meta", "response_item", "event_msg", "compacted"), F.col("outer"))
        .when(is_item & ~F.coalesce(known, F.lit(False)), F.concat(F.lit("response_item/"), item))
        .when(is_message & spoke & (role == "user") & F.col("is_injected"), "injected")
        .when(is_message & spoke & ~role.isin("user", "assistant"), F.concat(F.lit("message/"), role))
        .when((F.col("outer") == "event_msg") & ~item.isin("task_complete", "turn_aborted"), F.concat(F.lit("event_msg/"), item))
    )
    return rows.withColumn("skipped", skipped)


def rollout_events(records: DataFrame) -> DataFrame:
    """records(session_id, seq, record, is_error) as events; results carry what their calls say."""
    p, ordinal, outer, item, said, role = (F.col(c) for c in ("p", "ordinal", "outer", "item", "said", "role"))
    rows = staged(records).withColumns({"command": V.first_filled(F.col("args"), ROLLOUT_COMMAND_KEYS, X.strip), "code": X.exit_code(F.col("output"))})
    sources = F.array(F.coalesce(V.string(F.col("args"), "$.input"), F.col("raw")), F.coalesce("command", F.lit("")))
    is_call = (outer == "response_item") & item.isin("function_call", "custom_tool_call")
    rows = rows.withColumn("sources", F.when(is_call, sources))
    rows = rows.withColumns(
        {
            "names": F.flatten(F.transform("sources", named_files)),
            "stats": X.patch_stats(F.array_join(F.filter("sources", lambda s: F.contains(s, F.lit("*** "))), "\n")),
            "failed": X.looks_failed(F.col("code"), F.col("output")),
            "reason": F.coalesce(V.filled(p, "$.reason"), F.lit("unknown")),
        }
    )
    rows = rows.withColumns({"paths": F.transform("names", lambda n: n["path"]), "files": F.when(F.size("names") > 0, described(F.col("names"), F.col("stats")))})
    same = {"ordinal": ordinal}
    user = event(**same, type="user_message", role="user", content=said, significance=3)
    reply = event(**same, type="assistant_message", role="assistant", content=said, kind="assistant_message", significance=2)
    reasoning = event(**same, type="reasoning", role="assistant", content=X.truncate(F.col("thought"), TEXT_LIMIT), kind="reasoning_summary", significance=1)
    call_id = F.coalesce(V.filled(p, "$.call_id"), V.filled(p, "$.id"))
    call = event(
        **same, type="tool_call", role="assistant", content=X.truncate(F.col("raw"), TEXT_LIMIT), tool_name=F.coalesce(V.filled(p, "$.name"), F.lit("unknown_tool")),
        command=F.col("command"), call_id=call_id, kind="tool_call", paths=F.col("paths"), files=F.col("files"),
        category_hint=F.when(F.size("paths") > 0, "file_edit"), significance=2,
    )
    result = event(
        **same, type="tool_result", role="tool", content=X.truncate(F.col("output"), OUTPUT_LIMIT), result=X.truncate(X.without_envelope(F.col("output")), OUTPUT_LIMIT),
        tool_name=V.string(p, "$.name"), call_id=call_id, kind="tool_output", exit_code=F.col("code"), is_failure=F.col("failed"),
        significance=F.when(F.col("failed"), 2).otherwise(1),
    )
    aborted = event(**same, type="error", content=X.filled(LABEL["aborted"], F.col("reason")), kind="turn_aborted", reason=F.col("reason"), significance=2)
    finished = event(**same, type="assistant_message", role="assistant", content=F.col("done"), kind="task_complete", significance=2)
    place = F.coalesce(V.filled(p, "$.cwd"), F.lit(LABEL["unknown_folder"]))
    started = event(**same, type="session_meta", content=X.filled(LABEL["started"], place), kind="session_start", significance=1)
    compacted = event(**same, type="session_meta", content=LABEL["compacted"], kind="compacted", significance=1)
    is_item, is_message = outer == "response_item", (outer == "response_item") & (item == "message") & (said != "")
    made = (
        F.when(p.isNull() | F.col("skipped").isNotNull(), None)
        .when(outer == "session_meta", started)
        .when(outer == "compacted", compacted)
        .when(is_message & (role == "user"), user)
        .when(is_message & (role == "assistant"), reply)
        .when(is_item & (item == "reasoning") & (F.col("thought") != ""), reasoning)
        .when(is_call, call)
        .when(is_item & item.isin("function_call_output", "custom_tool_call_output"), result)
        .when((outer == "event_msg") & (item == "task_complete") & (X.strip(F.col("done")) != ""), finished)
        .when((outer == "event_msg") & (item == "turn_aborted"), aborted)
    )
    return with_calls(numbered(rows.select("session_id", "seq", F.lit(0).alias("place"), "ts", made.alias("e")), AGENT))


def rollout_counters(records: DataFrame) -> DataFrame:
    return counted(staged(records))


def rollout_sessions(records: DataFrame) -> DataFrame:
    """One row per session: what its records say of it, by the rules of each field."""
    rows = staged(records).filter("p is not null")
    p = F.col("p")
    when = lambda outer, value: F.when(F.col("outer") == outer, value)
    meta = lambda *names: F.coalesce(*[when("session_meta", V.filled(p, f"$.{n}")) for n in names])
    local = "$.state.environments.environments.local"
    any_cwd = F.coalesce(meta("cwd"), when("turn_context", V.filled(p, "$.cwd")), when("world_state", V.filled(p, f"{local}.cwd")))
    stated = last_of(meta("cwd"))
    return rows.groupBy("session_id").agg(
        last_of(meta("session_id", "id")).alias("stated_id"),
        F.coalesce(stated, first_of(any_cwd)).alias("cwd"),
        last_of(F.coalesce(when("session_meta", X.iso_time(V.string(p, "$.timestamp"))), when("session_meta", F.col("ts")))).alias("created_at"),
        last_of(F.coalesce(meta("model"), when("turn_context", V.filled(p, "$.model")))).alias("model"),
        *[F.max_by(when("session_meta", V.string(p, f"$.{n}")), when("session_meta", F.col("seq"))).alias(n) for n in ("cli_version", "originator", "source")],
        last_of(meta("model_provider")).alias("model_provider"),
        last_of(when("world_state", V.filled(p, f"{local}.shell"))).alias("shell"),
        last_of(when("world_state", V.filled(p, "$.state.current_date"))).alias("current_date"),
        last_of(when("world_state", V.filled(p, "$.state.timezone"))).alias("timezone"),
        F.coalesce(F.max(F.col("ts")), F.lit(None).cast("timestamp")).alias("updated_at"),
    )
