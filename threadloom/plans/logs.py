"""The test tables as logs: a user's log is the conversation with the user's number, then the user's events as tool calls.

The logs are made as JSON texts, as a reader gives them, so the queries over them parse and normalise all of it.  The
SQL beside them never sees JSON: it says what the rows of the tables have to become.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import united
from ..operators import classify, normalise
from ..sources import call_log, project_log, rollout
from .shared import written
from .testdata import COMMANDS, TOOL_SQL, messages_of, tool_events

RECORDS = "session_id string, seq long, record string, is_error boolean"
#: Places of a session's tool records start here, behind its messages.
FIRST = 1000
NAMES = ["exec_command", "exec_command", "read_file", "exec_command", "exec_command"]


def _json(**fields: Column | str | None) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items() if v is not None])


def _text(record: Column) -> Column:
    return F.to_json(record)


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _spoken() -> Column:
    return F.concat(F.lit("2020-01-01T00:00:"), F.lpad((F.col("turn") % 60).cast("string"), 2, "0"), F.lit("Z"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Tool events with what their records say."""
    k, path = F.col("k"), F.col("path")
    plus = F.expr("repeat('\n+x', k % 4 + 1)")
    patch = F.concat(F.lit("apply_patch <<'P'\n*** Begin Patch\n*** Update File: "), path, F.lit("\n@@\n-y"), plus, F.lit("\n*** End Patch\nP"))
    command = F.when(k % 5 == 4, patch).when(k % 5 != 2, F.col("full_command"))
    output = F.when(F.col("event_type") == "error", F.concat(F.lit("Process exited with code 1\nOutput:\n"), "error")).otherwise(F.concat(F.lit("Process exited with code 0\nOutput:\nok "), k.cast("string")))
    return tool_events(spark, d).withColumns({"cmd": command, "said": output, "call": F.concat(F.lit("c"), F.col("seq").cast("string")), "sid": F.col("session_id").cast("string")})


def _rows(df: DataFrame, session: Column, seq: Column, record: Column) -> DataFrame:
    return df.select(session.cast("string").alias("session_id"), seq.cast("long").alias("seq"), _text(record).alias("record"), F.lit(False).alias("is_error"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    users = tool_events(spark, d).select(F.col("session_id").alias("conv_id")).distinct()
    return messages_of(spark, d).join(users, "conv_id", "left_semi")


def rollout_records(spark: SparkSession, d: str) -> DataFrame:
    calls, turns = _calls(spark, d), _turns(spark, d)
    wrap = lambda kind, payload, ts, ordinal: _json(timestamp=ts, ordinal=ordinal, type=kind, payload=payload)
    head = calls.groupBy("sid").agg(F.min("ts").alias("ts"), F.max("session_id").alias("n"))
    meta = _json(session_id="sid", cwd=F.concat(F.lit("/work/p"), (F.col("n") % 7).cast("string")), cli_version="1.0", model_provider="m")
    meta = meta.withField("session_id", F.col("sid"))
    first = _rows(head, F.col("sid"), F.lit(0), wrap("session_meta", meta, _stamp(F.col("ts")), F.lit(0)))
    role = F.when(F.col("role") == "system", "developer").otherwise(F.col("role"))
    block = F.array(_json(type="text", text=F.col("text")))
    said = _rows(turns, F.col("conv_id"), F.col("turn") + 1, wrap("response_item", _json(type="message", role=role, content=block), _spoken(), F.col("turn") + 1))
    at = F.col("seq") * 10 + FIRST
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("k") % 5 + 1)
    args = F.when(F.col("cmd").isNotNull(), F.to_json(F.struct("cmd"))).otherwise(F.to_json(F.struct("path")))
    call = wrap("response_item", _json(type="function_call", name=name, arguments=args, call_id=F.col("call")), _stamp(F.col("ts")), at)
    out = wrap("response_item", _json(type="function_call_output", call_id=F.col("call"), output=F.col("said")), _stamp(F.col("ts")), at + 1)
    k = F.col("k")
    kind = F.when(k < 3, "turn_aborted").when(k >= 97, "task_complete").otherwise("token_count")
    note = _json(type=kind, reason=F.when(k < 3, F.concat(F.lit("user "), k.cast("string"))), last_agent_message=F.when(k >= 97, F.concat(F.lit("finished step "), k.cast("string"))))
    noted = wrap("event_msg", note, _stamp(F.col("ts")), at)
    one = lambda seq, record: F.struct(seq.cast("long").alias("seq"), _text(record).alias("record"))
    made = F.when(F.col("event_type") == "signup", F.array(one(at, noted))).otherwise(F.array(one(at, call), one(at + 1, out)))
    tools = calls.select(F.col("sid").alias("session_id"), F.inline(made)).withColumn("is_error", F.lit(False))
    return united(first, said, tools)


def project_records(spark: SparkSession, d: str) -> DataFrame:
    calls, turns = _calls(spark, d).filter("event_type != 'signup'"), _turns(spark, d)
    uuid = F.concat(F.lit("t"), F.col("turn").cast("string"))
    kind = F.when(F.col("role") == "assistant", "assistant").when(F.col("role") == "system", "system").otherwise("user")
    said = _json(type=kind, uuid=uuid, timestamp=_spoken(), sessionId="s", isSidechain=F.col("turn") % 5 == 4, message=_json(role=F.col("role"), content=F.col("text")))
    at = F.col("seq") * 10 + FIRST
    read = F.col("k") % 5 == 2
    use = _json(type="tool_use", id=F.col("call"), name=F.when(read, "Read").otherwise("Bash"), input=_json(command=F.when(~read, F.col("full_command")), file_path=F.when(read, F.col("path"))))
    think = _json(type="thinking", thinking=F.concat(F.lit("step "), F.col("k").cast("string")))
    blocks = F.array(F.to_json(think), F.to_json(use))
    call = F.concat(F.lit('{"type":"assistant","uuid":"u'), F.col("seq").cast("string"), F.lit('","timestamp":"'), _stamp(F.col("ts")), F.lit('","message":{"content":['), F.array_join(blocks, ","), F.lit("]}}"))
    bad = F.col("event_type") == "error"
    block = _json(type="tool_result", tool_use_id=F.col("call"), is_error=bad, content=F.when(bad, F.col("error")).otherwise("fine"))
    result = _json(type="user", uuid=F.concat(F.lit("r"), F.col("seq").cast("string")), timestamp=_stamp(F.col("ts")), message=_json(role="user", content=F.array(block)))
    called = calls.select(F.col("sid").alias("session_id"), at.alias("seq"), call.alias("record"), F.lit(False).alias("is_error"))
    return united(_rows(turns, F.col("conv_id"), F.col("turn"), said), called, _rows(calls, F.col("sid"), at + 1, result))


def call_records(spark: SparkSession, d: str) -> DataFrame:
    calls, turns = _calls(spark, d).filter("event_type != 'signup'"), _turns(spark, d)
    wrapped = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.concat(F.lit("<system-reminder>x</system-reminder>\n<user_query> "), "text", F.lit(" </user_query>"))).otherwise(F.col("text"))
    kind = F.when(F.col("role") == "system", "snapshot").otherwise("message")
    said = _json(id=F.concat(F.lit("t"), F.col("turn").cast("string")), timestamp=F.lit(1_700_000_000_000) + F.col("turn"), type=kind, role=F.col("role"), content=F.array(_json(type="text", text=wrapped)), cwd="/w", providerData=_json(model="m"))
    at = F.col("seq") * 10 + FIRST
    read = F.col("k") % 5 == 2
    args = F.when(read, F.to_json(F.struct(F.col("path").alias("file_path")))).otherwise(F.to_json(F.struct(F.col("full_command").alias("command"))))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    call = _json(id=F.concat(F.lit("a"), F.col("seq").cast("string")), timestamp=ms, type="function_call", name=F.when(read, "Read").otherwise("Bash"), callId=F.col("call"), arguments=args)
    bad = F.col("event_type") == "error"
    status = F.when(bad & (F.col("k") % 2 == 0), "failed").otherwise("completed")
    text = F.when(bad & (F.col("k") % 2 == 1), F.concat(F.lit("[ERROR] "), "error")).otherwise("fine")
    result = _json(id=F.concat(F.lit("b"), F.col("seq").cast("string")), timestamp=ms, type="function_call_result", callId=F.col("call"), status=status, output=F.array(_json(type="text", text=text)))
    return united(_rows(turns, F.col("conv_id"), F.col("turn"), said), _rows(calls, F.col("sid"), at, call), _rows(calls, F.col("sid"), at + 1, result))


def bubbles(spark: SparkSession, d: str) -> DataFrame:
    """session_id, seq, v, as the key-value reader gives them: turns, and purchases as suggested changes."""
    turns = _turns(spark, d)
    by = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    tree = F.to_json(_json(type="doc", content=F.array(_json(type="paragraph", content=F.array(_json(type="text", text=F.col("text")))))))
    rich = F.col("turn") % 2 == 0
    said = _json(type=by, bubbleId=F.concat(F.lit("t"), F.col("turn").cast("string")), createdAt=_spoken(), text=F.when(~rich, F.col("text")), richText=F.when(rich, tree), thinking=_json(text=F.when(F.col("turn") % 3 == 0, "hm")))
    edits = _calls(spark, d).filter("event_type = 'purchase'")
    diff = _json(path=F.col("path"), diff=F.concat(F.lit("@@\n-y"), F.expr("repeat('\n+x', k % 4 + 1)")))
    changed = _json(type=F.lit(2), bubbleId=F.concat(F.lit("e"), F.col("seq").cast("string")), createdAt=_stamp(F.col("ts")), assistantSuggestedDiffs=F.array(diff), toolResults=F.array(_json(name="t", result=F.col("said"), isError=F.col("k") % 2 == 1)))
    rows = united(_rows(turns, F.col("conv_id"), F.col("turn") + 1, said), _rows(edits, F.col("sid"), F.col("seq") + FIRST, changed))
    return rows.select("session_id", "seq", F.try_parse_json("record").alias("v"))


FORMATS = {
    "rollout": (rollout_records, rollout.rollout_events),
    "project-log": (project_records, project_log.project_log_events),
    "call-log": (call_records, call_log.call_log_events),
}


def parsed(spark: SparkSession, d: str, name: str = "rollout") -> DataFrame:
    records, events = FORMATS[name]
    return events(records(spark, d))


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """The normalised rollouts, written once so that the sections of a document read them rather than parse again."""
    return written(normalise.normalise(written(parsed(spark, d), "events")), "normalised")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    n = tool_events(spark, d).select("session_id").distinct()
    return n.select(F.col("session_id").cast("string").alias("session_id"), F.lit("codex").alias("agent"), F.concat(F.lit("/work/p"), (F.col("session_id") % 7).cast("string")).alias("cwd"), F.lit(None).cast("string").alias("model"))


def project(spark: SparkSession, d: str) -> DataFrame:
    n = tool_events(spark, d).select("session_id").distinct()
    return n.select(
        F.col("session_id").cast("string").alias("session_id"), F.concat(F.lit("/work/p"), (F.col("session_id") % 7).cast("string")).alias("cwd"), (F.col("session_id") % 5 > 0).alias("exists"),
        (F.col("session_id") % 2 == 0).alias("is_git"), F.array(F.lit("keep it small")).alias("constraints"), (F.col("session_id") % 3).cast("int").alias("n_changed"),
    )


# --- the same for DuckDB -----------------------------------------------------------------------------------------------

quoted = lambda s: s.replace("'", "''")
matches = lambda c, pattern: f"regexp_matches({c}, '{quoted(pattern)}')"
#: u: turns of users that have events; x: tool events with what their records say.
LOG_SQL = f"""{TOOL_SQL},
u AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE conv_id IN (SELECT session_id FROM t)),
x AS (
  SELECT * EXCLUDE (session_id), CAST(session_id AS VARCHAR) AS session_id, session_id AS n, (seq * 10 + {FIRST}) * 1000 AS place, 'c' || seq AS call_id, k % 4 + 1 AS plus,
    CASE WHEN k % 5 = 4 THEN 'apply_patch <<''P''' || chr(10) || '*** Begin Patch' || chr(10) || '*** Update File: ' || path || chr(10) || '@@' || chr(10) || '-y' || repeat(chr(10) || '+x', k % 4 + 1)
      || chr(10) || '*** End Patch' || chr(10) || 'P' WHEN k % 5 <> 2 THEN full_command END AS cmd
  FROM t)"""
_FAILED = f"(event_type = 'error' AND NOT coalesce({matches('cmd', classify.SEARCH)}, false))"
#: n: normalised rows: session_id, seq, ts, type, category, command, path, is_failure, exit_code, error, kind, reason, content, plus.
NORM_SQL = f"""{LOG_SQL},
n0 AS (
  SELECT session_id, place AS seq, ts, cmd AS command, CASE WHEN k % 5 = 4 THEN path END AS path, {_FAILED} AS is_failure, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
    CASE WHEN event_type = 'error' THEN error ELSE '' END AS error, CASE WHEN event_type = 'error' THEN error ELSE 'ok ' || k END AS result, plus, k,
    CASE WHEN k % 5 = 2 THEN 'file_read' WHEN k % 5 = 4 THEN 'file_edit' WHEN {matches('cmd', classify.TEST)} THEN 'test' WHEN {matches('cmd', classify.BUILD)} THEN 'build' ELSE 'terminal' END AS category
  FROM x WHERE event_type <> 'signup'),
n1 AS (
  SELECT session_id, seq, ts, CASE WHEN category IN ('test', 'build') THEN 'test' ELSE category END AS type, category, command, path, is_failure, exit_code, error, result,
    CASE WHEN is_failure THEN 3 WHEN exit_code = 1 THEN 1 ELSE 2 END AS significance, NULL AS kind, NULL AS reason, NULL AS content, plus FROM n0
  UNION ALL SELECT session_id, place, ts, CASE WHEN k < 3 THEN 'error' ELSE 'assistant_message' END, CASE WHEN k < 3 THEN 'error' ELSE 'assistant_message' END, NULL, NULL, k < 3, NULL, '', '',
    2, CASE WHEN k < 3 THEN 'turn_aborted' ELSE 'task_complete' END, CASE WHEN k < 3 THEN 'user ' || k END,
    CASE WHEN k < 3 THEN '本轮任务被中断（reason=user ' || k || '）' ELSE 'finished step ' || k END, 0 FROM x WHERE event_type = 'signup' AND (k < 3 OR k >= 97)
  UNION ALL SELECT session_id, 0, min(ts), 'session_meta', 'meta', NULL, NULL, false, NULL, '', '', 1, 'session_start', NULL, 'Codex 会话开始（/work/p' || (max(n) % 7) || '）', 0 FROM x GROUP BY session_id
  UNION ALL SELECT session_id, (turn + 1) * 1000, TIMESTAMP '2020-01-01' + to_seconds(turn % 60), role || '_message', role || '_message', NULL, NULL, false, NULL, '', '',
    CASE role WHEN 'user' THEN 3 ELSE 2 END, CASE role WHEN 'assistant' THEN 'assistant_message' END, NULL, text, 0 FROM u WHERE role <> 'system' AND text <> ''),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, type, content ORDER BY seq) AS rn FROM n1)
      WHERE type NOT IN ('user_message', 'assistant_message') OR length(content) <= 40 OR rn = 1)"""
assert len(COMMANDS) == 24
