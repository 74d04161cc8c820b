"""The registered queries over logs: parsing, normalisation, masking and the sections of state documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixed import LABEL, NO_SECRETS, RISKS, SECRET_RULES
from ..functions import text as X
from ..functions.tables import united
from ..operators import aggregate as A
from ..operators import compress, memory, redact, render
from ..sources import bubble_kv, call_log, project_log, rollout
from ..sources import events as sources
from . import logs
from .logs import LOG_SQL, NORM_SQL, matches, quoted
from .queries import _BARE_END, _CUT, _KEY, _STRIP, query
from .shared import written
from .testdata import table

N = NORM_SQL
say = lambda name, *values: "'" + quoted(LABEL[name]).replace("{}", "' || {} || '").format(*values) + "'"
joined = lambda c, sep=",": F.array_join(c, sep)
counts = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


# --- parsing -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG_SQL}
SELECT session_id, place AS seq, 'tool_call' AS type, 'assistant' AS role, cmd AS command, CASE WHEN k % 5 = 2 THEN 'read_file' ELSE 'exec_command' END AS tool_name, call_id,
  CAST(NULL AS INTEGER) AS exit_code, CAST(NULL AS BOOLEAN) AS is_failure, CAST(NULL AS VARCHAR) AS result, CAST(NULL AS BIGINT) AS call_seq,
  CASE WHEN k % 5 = 4 THEN path || ':modified:1:' || plus || ':1' ELSE '' END AS files, CASE WHEN k % 5 = 4 THEN 'file_edit' END AS hint FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, place + 1000, 'tool_result', 'tool', cmd, CASE WHEN k % 5 = 2 THEN 'read_file' ELSE 'exec_command' END, call_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END,
  event_type = 'error', CASE WHEN event_type = 'error' THEN error ELSE 'ok ' || k END, place, '', NULL FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, place, CASE WHEN k < 3 THEN 'error' ELSE 'assistant_message' END, CASE WHEN k >= 97 THEN 'assistant' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL
  FROM x WHERE event_type = 'signup' AND (k < 3 OR k >= 97)
UNION ALL SELECT DISTINCT session_id, 0, 'session_meta', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL FROM x
UNION ALL SELECT session_id, (turn + 1) * 1000, role || '_message', role, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '', NULL FROM u WHERE role <> 'system' AND text <> ''""")
def p1_rollout_events(spark, d):
    files = F.transform("files", lambda f: F.concat_ws(":", f["path"], f["status"], f["hunks"].cast("string"), f["added"].cast("string"), f["removed"].cast("string")))
    return logs.parsed(spark, d).select(
        "session_id", "seq", "type", "role", "command", "tool_name", "call_id", "exit_code", "is_failure", "result", "call_seq", F.coalesce(joined(files), F.lit("")).alias("files"),
        F.col("category_hint").alias("hint"),
    )


@query(f"""WITH {LOG_SQL} SELECT session_id, session_id AS stated_id, '/work/p' || (max(n) % 7) AS cwd, '1.0' AS cli_version, 'm' AS model_provider FROM x GROUP BY session_id""")
def p2_rollout_sessions(spark, d):
    return rollout.rollout_sessions(logs.rollout_records(spark, d)).select("session_id", "stated_id", "cwd", "cli_version", "model_provider")


@query(f"""WITH {LOG_SQL},
r AS (SELECT session_id, CASE WHEN k BETWEEN 3 AND 96 THEN 'event_msg/token_count' END AS reason FROM x WHERE event_type = 'signup'
  UNION ALL SELECT session_id, NULL FROM x WHERE event_type <> 'signup' UNION ALL SELECT session_id, NULL FROM x WHERE event_type <> 'signup' UNION ALL SELECT DISTINCT session_id, NULL FROM x
  UNION ALL SELECT session_id, CASE WHEN role = 'system' AND text <> '' THEN 'message/developer' END FROM u),
g AS (SELECT session_id, reason, count(*) AS c FROM r GROUP BY ALL)
SELECT session_id, CAST(sum(c) AS BIGINT) AS n_records, CAST(coalesce(sum(c) FILTER (reason IS NULL), 0) AS BIGINT) AS n_used,
  coalesce(string_agg(reason || '=' || c, ',' ORDER BY reason) FILTER (reason IS NOT NULL), '') AS skipped FROM g GROUP BY session_id""")
def a1_parse_counters(spark, d):
    return rollout.rollout_counters(logs.rollout_records(spark, d)).select("session_id", "n_records", "n_used", counts("skipped").alias("skipped"))


_PROJECT = f"""WITH {LOG_SQL},
o AS (SELECT session_id, place + 1000 AS seq, 'reasoning' AS type, NULL AS tool_name, NULL AS command, '' AS paths, NULL AS hint, CAST(NULL AS INTEGER) AS exit_code, CAST(NULL AS BOOLEAN) AS is_failure, 'step ' || k AS content, CAST(NULL AS BIGINT) AS call_seq FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, place + 2, 'tool_call', CASE WHEN k % 5 = 2 THEN 'Read' ELSE 'Bash' END, CASE WHEN k % 5 <> 2 THEN full_command END, CASE WHEN k % 5 = 2 THEN path ELSE '' END, CASE WHEN k % 5 = 2 THEN 'file_read' ELSE 'terminal' END, NULL, NULL, NULL, NULL FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, place + 1001, 'tool_result', CASE WHEN k % 5 = 2 THEN 'Read' ELSE 'Bash' END, CASE WHEN k % 5 <> 2 THEN full_command END, CASE WHEN k % 5 = 2 THEN path ELSE '' END, NULL,
  CASE WHEN event_type = 'error' THEN 1 END, event_type = 'error', CASE WHEN event_type = 'error' THEN error ELSE 'fine' END, place + 2 FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, turn * 1000, role || '_message', NULL, NULL, '', NULL, NULL, NULL, text, NULL FROM u WHERE role <> 'system' AND text <> '' AND turn % 5 <> 4)"""


@query(_PROJECT + " SELECT * REPLACE (CASE WHEN type = 'reasoning' THEN seq - 999 ELSE seq END AS seq) FROM o")
def p9_project_log_events(spark, d):
    e = logs.parsed(spark, d, "project-log")
    content = F.when(F.col("type") != "tool_call", F.col("content"))
    return e.select("session_id", "seq", "type", "tool_name", "command", F.coalesce(joined("paths"), F.lit("")).alias("paths"), F.col("category_hint").alias("hint"), "exit_code", "is_failure", content.alias("content"), "call_seq")


@query(f"""WITH {LOG_SQL}, s AS (SELECT session_id, true AS any FROM x WHERE event_type <> 'signup' UNION SELECT session_id, true FROM u WHERE turn % 5 <> 4),
t1 AS (SELECT session_id, 's' AS stated_id FROM u WHERE turn % 5 <> 4 GROUP BY 1) SELECT DISTINCT s.session_id, coalesce(stated_id, s.session_id) AS stated_id FROM s LEFT JOIN t1 USING (session_id)""")
def p10_project_log_sessions(spark, d):
    return project_log.project_log_sessions(logs.project_records(spark, d)).select("session_id", "stated_id")


@query(f"""WITH {LOG_SQL}
SELECT session_id, place AS seq, 'tool_call' AS type, CASE WHEN k % 5 = 2 THEN 'Read' ELSE 'Bash' END AS tool_name, CASE WHEN k % 5 <> 2 THEN full_command END AS command, CASE WHEN k % 5 = 2 THEN path ELSE '' END AS paths,
  CAST(NULL AS BOOLEAN) AS is_failure, CAST(NULL AS VARCHAR) AS content, CAST(NULL AS BIGINT) AS call_seq FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, place + 1000, 'tool_result', CASE WHEN k % 5 = 2 THEN 'Read' ELSE 'Bash' END, CASE WHEN k % 5 <> 2 THEN full_command END, CASE WHEN k % 5 = 2 THEN path ELSE '' END, event_type = 'error',
  CASE WHEN event_type = 'error' AND k % 2 = 1 THEN '[ERROR] ' || error ELSE 'fine' END, place FROM x WHERE event_type <> 'signup'
UNION ALL SELECT session_id, turn * 1000, role || '_message', NULL, NULL, '', NULL, text, NULL FROM u WHERE role <> 'system' AND text <> ''""")
def p19_call_log_events(spark, d):
    content = F.when(F.col("type") != "tool_call", F.col("content"))
    return logs.parsed(spark, d, "call-log").select("session_id", "seq", "type", "tool_name", "command", F.coalesce(joined("paths"), F.lit("")).alias("paths"), "is_failure", content.alias("content"), "call_seq")


@query(f"""WITH {LOG_SQL}, s AS (SELECT session_id FROM x WHERE event_type <> 'signup' UNION SELECT session_id FROM u)
SELECT s.session_id, max(CASE WHEN u.session_id IS NOT NULL THEN '/w' END) AS cwd, max(CASE WHEN u.session_id IS NOT NULL THEN 'm' END) AS model FROM s LEFT JOIN u USING (session_id) GROUP BY 1""")
def p24_call_log_sessions(spark, d):
    return call_log.call_log_sessions(logs.call_records(spark, d)).select("session_id", "cwd", "model")


@query(f"""WITH {LOG_SQL}, p AS (SELECT *, (seq + {logs.FIRST}) * 1000 AS spot, 'error' = event_type AS bad FROM x WHERE event_type = 'purchase')
SELECT session_id, (turn + 1) * 1000 AS seq, 'user_message' AS type, text AS content, '' AS files, CAST(NULL AS BOOLEAN) AS is_failure FROM u WHERE role = 'user' AND text <> ''
UNION ALL SELECT session_id, (turn + 1) * 1000, 'reasoning', 'hm', '', NULL FROM u WHERE role = 'assistant' AND turn % 3 = 0
UNION ALL SELECT session_id, (turn + 1) * 1000 + 1, 'assistant_message', text, '', NULL FROM u WHERE role = 'assistant' AND text <> ''
UNION ALL SELECT session_id, spot + 2, 'tool_call', NULL, path || ':1:' || plus || ':1', NULL FROM p
UNION ALL SELECT session_id, spot + 5, 'tool_result', 'Process exited with code 0' || chr(10) || 'Output:' || chr(10) || 'ok ' || k, '', k % 2 = 1 FROM p""")
def p15_bubble_events(spark, d):
    files = F.transform("files", lambda f: F.concat_ws(":", f["path"], *[f[c].cast("string") for c in ("hunks", "added", "removed")]))
    content = F.when(F.col("type") != "tool_call", X.strip(F.col("content")))
    return bubble_kv.bubble_events(logs.bubbles(spark, d)).select("session_id", "seq", "type", content.alias("content"), F.coalesce(joined(files), F.lit("")).alias("files"), "is_failure")


@query(f"""WITH {LOG_SQL} SELECT 'codex' AS agent, count(*) AS n FROM (SELECT 1 FROM x WHERE event_type <> 'signup' UNION ALL SELECT 1 FROM x WHERE event_type <> 'signup' OR k < 3 OR k >= 97
  UNION ALL SELECT 1 FROM (SELECT DISTINCT session_id FROM x) UNION ALL SELECT 1 FROM u WHERE role <> 'system' AND text <> '')
UNION ALL SELECT 'workbuddy', count(*) FROM (SELECT 1 FROM x WHERE event_type <> 'signup' UNION ALL SELECT 1 FROM x WHERE event_type <> 'signup' UNION ALL SELECT 1 FROM u WHERE role <> 'system' AND text <> '')
UNION ALL SELECT 'claude', count(*) FROM (SELECT 1 FROM x, range(3) WHERE event_type <> 'signup' UNION ALL SELECT 1 FROM u WHERE role <> 'system' AND text <> '' AND turn % 5 <> 4)
UNION ALL SELECT 'cursor', count(*) FROM (SELECT 1 FROM x, range(2) WHERE event_type = 'purchase' UNION ALL SELECT 1 FROM u WHERE role IN ('user', 'assistant') AND text <> '' UNION ALL SELECT 1 FROM u WHERE role = 'assistant' AND turn % 3 = 0)""")
def u1_formats_union(spark, d):
    """The events of all four formats in one table, counted by format."""
    from ..sources.formats import events_of

    records = {"rollout": logs.rollout_records(spark, d), "call-log": logs.call_records(spark, d), "project-log": logs.project_records(spark, d)}
    every = united(events_of(records), bubble_kv.bubble_events(logs.bubbles(spark, d)))
    return every.groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


# --- normalisation -----------------------------------------------------------------------------------------------------

_SUMMARY = f"""CASE type WHEN 'test' THEN CASE category WHEN 'build' THEN '{LABEL["build_word"]}' ELSE '{LABEL["test_word"]}' END || CASE WHEN is_failure THEN '{LABEL["failed_word"]}' ELSE '{LABEL["passed_word"]}' END || '：' || command
  WHEN 'terminal' THEN '{LABEL["command"]}' || command WHEN 'file_edit' THEN '{LABEL["edit"]}' || path || '（1 处，+' || plus || '/-1）' WHEN 'file_read' THEN '{LABEL["search"]}read_file'
  WHEN 'error' THEN content WHEN 'session_meta' THEN content ELSE {_CUT(_STRIP.format("string_split(" + _STRIP.format("content") + ", chr(10))[1]"), 160)} END"""


@query(f"WITH {N} SELECT session_id, seq, type, category, command, path, is_failure, exit_code, significance, error, {_SUMMARY} AS summary FROM n")
def n1_normalised(spark, d):
    n = logs.normalised(spark, d)
    error = F.when(F.col("exit_code") == 1, X.first_error_line(F.col("result"))).otherwise("")
    return n.select("session_id", "seq", "type", "category", "command", F.get("paths", F.lit(0)).alias("path"), "is_failure", "exit_code", "significance", error.alias("error"), "summary")


@query(f"WITH {N} SELECT session_id, count(*) FILTER (exit_code = 1 AND NOT is_failure) AS n_normal, count(*) FILTER (exit_code IS NOT NULL) AS n_attached FROM n GROUP BY 1")
def j2_attached_results(spark, d):
    return logs.normalised(spark, d).groupBy("session_id").agg(F.count_if("nonzero_is_normal").alias("n_normal"), F.count_if("result_attached").alias("n_attached"))


# --- masking -----------------------------------------------------------------------------------------------------------

_GROUPS = {"credential_assignment": 3, "bearer_token": 1, "jdbc_url_with_password": 2}
_EASY = [k for k, (p, g, s, _) in SECRET_RULES.items() if "(?!" not in p and k != "env_secret_var"]
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, '{SECRET_RULES[k][2]}' AS severity, unnest(regexp_extract_all(coalesce(text, ''), '{quoted(SECRET_RULES[k][0])}', {_GROUPS.get(k, 0)})) AS value FROM documents" for k in _EASY
)
_WORDS = ", ".join(f"'{w}'" for w in NO_SECRETS)
_FINDINGS = f"""WITH a AS ({_FOUND}), f AS (SELECT * FROM a WHERE severity <> 'medium' OR (lower(value) NOT IN ({_WORDS}) AND (length(value) >= 12 OR regexp_matches(value, '[0-9]'))))"""


@query(_FINDINGS + " SELECT doc_id, kind, severity, CAST(length(value) AS BIGINT) AS n FROM f")
def r4_secret_findings(spark, d):
    """The findings of the rules that both engines can state; where two rules find one span the more specific one has it."""
    return redact.findings(table(spark, d, "documents"), "doc_id").filter(F.col("kind").isin(_EASY)).select("doc_id", "kind", "severity", "n")


@query(_FINDINGS + " SELECT kind, severity, count(*) AS n FROM f GROUP BY ALL")
def a18_findings_by_kind(spark, d):
    return redact.findings(table(spark, d, "documents"), "doc_id").filter(F.col("kind").isin(_EASY)).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def r5_redacted_text(spark, d):
    return redact.redact(table(spark, d, "documents")).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query(_FINDINGS + " SELECT doc_id, (SELECT count(*) FROM f WHERE f.doc_id = documents.doc_id) AS n, length(text) AS n_before FROM documents")
def r8_redacted_documents(spark, d):
    """Texts as documents that are masked through JSON and back, with the number of findings of the rules that both engines can state."""
    docs = table(spark, d, "documents").select("doc_id", F.struct("text", F.array("lang", "source").alias("tags")).alias("body"), F.length("text").cast("long").alias("n_before"))
    rows = redact.redact_documents(docs, ["doc_id", "n_before"])
    return rows.select("doc_id", F.size(F.filter("findings", lambda k: k.isin(_EASY))).cast("long").alias("n"), "n_before")


# --- sections ----------------------------------------------------------------------------------------------------------

_TOOLS = "('terminal', 'file_edit', 'file_read', 'build', 'test', 'tool_call')"
#: c: counts; f: failures with their label and whether resolved; tail: those among the last 15 rows.
_LABEL = f"CASE WHEN category = 'file_edit' THEN '{LABEL['edit']}' || path WHEN command IS NOT NULL THEN command ELSE {_SUMMARY} END"
SECTIONS = f"""{N},
c AS (SELECT session_id, count(*) AS total_events, count(*) FILTER (type = 'user_message') AS user_messages, count(*) FILTER (category IN {_TOOLS}) AS tool_calls,
  count(*) FILTER (category IN {_TOOLS} AND is_failure) AS failures, count(*) FILTER (category IN ('test', 'build')) AS test_runs, count(DISTINCT path) AS edited_files,
  bool_or(coalesce(kind, '') = 'turn_aborted') AS interrupted, max_by(coalesce(kind, '') = 'task_complete', seq) AS ended_clean FROM n GROUP BY 1),
f AS (SELECT a.*, {_LABEL} AS action, EXISTS (SELECT 1 FROM n b WHERE b.session_id = a.session_id AND b.command = a.command AND NOT b.is_failure AND b.ts > a.ts) AS resolved FROM n a WHERE is_failure),
open AS (SELECT f.* FROM f JOIN (SELECT session_id, seq FROM (SELECT session_id, seq, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM n) WHERE back <= 15) USING (session_id, seq) WHERE NOT resolved),
p AS (SELECT DISTINCT session_id, '/work/p' || (n % 7) AS cwd, n % 5 > 0 AS there, n % 2 = 0 AS is_git, n % 3 AS n_changed FROM x)"""


@query(f"""WITH {SECTIONS} SELECT session_id, total_events, user_messages, tool_calls, failures, test_runs, edited_files,
CASE WHEN user_messages + tool_calls = 0 THEN 'unknown' WHEN user_messages = 0 OR user_messages + tool_calls < 8 THEN 'low' ELSE 'medium' END AS confidence FROM c""")
def d16_counts(spark, d):
    return memory.counts(logs.normalised(spark, d)).drop("interrupted", "ended_clean", "read_files")


@query(f"""WITH {SECTIONS} SELECT session_id, CASE WHEN interrupted THEN 'in_progress' WHEN session_id IN (SELECT session_id FROM open) THEN 'blocked' WHEN ended_clean AND failures = 0 THEN 'completed' ELSE 'in_progress' END AS status FROM c""")
def w5_task_status(spark, d):
    return memory.status(logs.normalised(spark, d))


@query(f"""WITH {SECTIONS} SELECT c.session_id, 'task_' || c.session_id AS id, {say("from_agent", "'codex'")} || '；' || {say("in_folder", "cwd")} || '；' || {say("counts", "user_messages", "tool_calls", "failures")} || CASE WHEN NOT there THEN '；{LABEL["path_gone"]}' ELSE '' END AS background,
'keep it small' AS constraints, CASE WHEN interrupted THEN 'in_progress' WHEN c.session_id IN (SELECT session_id FROM open) THEN 'blocked' WHEN ended_clean AND failures = 0 THEN 'completed' ELSE 'in_progress' END AS status,
CASE WHEN user_messages + tool_calls = 0 THEN 'unknown' WHEN user_messages = 0 OR user_messages + tool_calls < 8 THEN 'low' ELSE 'medium' END AS confidence, 'heuristic' AS reconstructed_by FROM c JOIN p USING (session_id)""")
def d14_task_section(spark, d):
    """The task section of all documents, but for its texts, which have queries of their own."""
    t = memory.task(logs.normalised(spark, d), logs.sessions(spark, d), logs.project(spark, d))
    return t.select("session_id", "id", "background", joined("constraints").alias("constraints"), "status", "confidence", "reconstructed_by")


_DONE = f"""{SECTIONS},
e AS (SELECT session_id, path, count(*) AS edits, sum(plus)::BIGINT AS added, min(seq) AS first_seq FROM n WHERE category = 'file_edit' GROUP BY ALL),
good AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS down FROM n WHERE category IN ('test', 'build') AND NOT is_failure)"""


@query(f"""WITH {_DONE} SELECT session_id, path, edits, edits AS hunks, added, edits AS removed, 'modified' AS status, {say("edit_summary", "edits", "added", "edits", "edits")} AS summary FROM e""")
def d15_edited_files(spark, d):
    return memory.edited_files(logs.normalised(spark, d)).drop("first")


@query(f"""WITH {_DONE},
l AS (SELECT session_id, {say("edit_count", "count(*)", "array_to_string(array_agg(path ORDER BY first_seq)[1:6], '、')")} AS line, 0 AS o FROM e GROUP BY 1
UNION ALL SELECT session_id, '{LABEL["passed_test"]}' || command, seq FROM good WHERE down <= 3)
SELECT session_id, string_agg(line, chr(10) ORDER BY o) AS completed FROM l GROUP BY 1 UNION ALL SELECT session_id, '' FROM c WHERE session_id NOT IN (SELECT session_id FROM l)""")
def a14_completed(spark, d):
    return memory.implementation(logs.normalised(spark, d)).select("session_id", joined("completed", "\n").alias("completed"))


@query(f"""WITH {SECTIONS} SELECT c.session_id, {say("summary_folder", "cwd")} || {say("summary", "user_messages", "tool_calls", "failures", "edited_files")} AS summary FROM c JOIN p USING (session_id)""")
def d2_conversation_summary(spark, d):
    n = logs.normalised(spark, d)
    return memory.conversation(n, logs.sessions(spark, d)).select("session_id", "summary")


_LINE = lambda c, n: _CUT(_STRIP.format(f"string_split({_STRIP.format(c)}, chr(10))[1]"), n)


@query(f"""WITH {SECTIONS},
r AS (SELECT session_id, type, seq, {_LINE("content", 140)} AS line, row_number() OVER (PARTITION BY session_id, type ORDER BY seq) AS up, row_number() OVER (PARTITION BY session_id, type ORDER BY seq DESC) AS down FROM n WHERE type IN ('user_message', 'assistant_message')),
q AS (SELECT session_id, line, min(o) AS o FROM (SELECT session_id, line, up AS o FROM r WHERE type = 'user_message' AND up <= 2 UNION ALL SELECT session_id, line, 10 - down FROM r WHERE type = 'user_message' AND down <= 2) GROUP BY ALL),
a AS (SELECT session_id, '{LABEL["conclusion"]}' || line AS line, 100 - down AS o FROM r WHERE type = 'assistant_message' AND down <= 3 AND NOT EXISTS (SELECT 1 FROM q WHERE q.session_id = r.session_id AND q.line = r.line)),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS nth FROM (SELECT * FROM q UNION ALL SELECT * FROM a))
SELECT c.session_id, coalesce(string_agg(line, chr(10) ORDER BY o), '') AS key_points FROM c LEFT JOIN k ON k.session_id = c.session_id AND nth <= 8 GROUP BY 1""")
def a15_key_points(spark, d):
    n = logs.normalised(spark, d)
    return memory.conversation(n, logs.sessions(spark, d)).select("session_id", joined("key_points", "\n").alias("key_points"))


_FLAT_TEXT = lambda c: _STRIP.format(f"regexp_replace({_STRIP.format(f'regexp_replace({c}, ' + chr(39) + '[ \\t　]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '\\s*\\n\\s*', ' ', 'g')")


@query(f"""WITH {SECTIONS},
g AS (SELECT c.session_id, coalesce(min_by(content, seq) FILTER (type = 'user_message'), '') AS first, coalesce(max_by(content, seq) FILTER (type = 'user_message'), '') AS last FROM c LEFT JOIN n USING (session_id) GROUP BY 1),
h AS (SELECT session_id, first, {_CUT(_FLAT_TEXT("first"), 400)} AS goal, {_FLAT_TEXT("last")} AS last FROM g),
k AS (SELECT *, CASE WHEN length(goal) < 60 AND last <> '' AND {_KEY("last", 40)} <> {_KEY("goal", 40)} THEN CASE WHEN goal <> '' THEN {_CUT("(goal || " + say("later_request", "last") + ")", 400)} ELSE {_CUT("last", 400)} END ELSE goal END AS whole FROM h)
SELECT session_id, CASE WHEN whole = '' THEN 'unknown' ELSE whole END AS goal FROM k""")
def x35_goal(spark, d):
    return memory.goals(logs.normalised(spark, d)).select("session_id", "goal")


@query(f"""WITH {SECTIONS}, k AS (SELECT *, {_KEY("action", 80)} AS key FROM f WHERE category IN {_TOOLS}),
g AS (SELECT session_id, key, min(seq) AS first_seq FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq) AS nth FROM g),
cut AS (SELECT session_id, max(first_seq) FILTER (nth = 15) AS cut FROM r WHERE nth <= 15 GROUP BY 1),
m AS (SELECT k.session_id, k.key, count(*) AS times FROM k JOIN cut USING (session_id) WHERE cut IS NULL OR seq <= cut GROUP BY ALL),
same AS (SELECT session_id, error, count(*) AS n_same FROM f WHERE category IN {_TOOLS} GROUP BY ALL)
SELECT r.session_id, nth, k.action, CASE WHEN category = 'build' THEN '{LABEL["build_word"] + LABEL["run_failed"]}' WHEN category = 'test' THEN '{LABEL["test_word"] + LABEL["run_failed"]}' ELSE k.error END
  || CASE WHEN times > 1 THEN {say("repeated", "times")} ELSE '' END AS result, k.error, false AS success,
  CASE WHEN resolved THEN '{LABEL["lesson_resolved"]}' WHEN n_same >= 3 THEN '{LABEL["lesson_same"]}' WHEN category = 'file_edit' THEN '{LABEL["lesson_edit"]}' END AS lesson
FROM r JOIN k ON k.session_id = r.session_id AND k.seq = first_seq JOIN m ON m.session_id = r.session_id AND m.key = r.key JOIN same ON same.session_id = r.session_id AND same.error = k.error WHERE nth <= 15
UNION ALL SELECT session_id, 1000 + row_number() OVER (PARTITION BY session_id ORDER BY seq), command, '{LABEL["fine"]}', NULL, true, NULL FROM
  (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS down FROM n WHERE category IN ('test', 'build') AND NOT is_failure) WHERE down <= 3""")
def a7_attempt_list(spark, d):
    return memory.attempts(logs.normalised(spark, d))


@query(f"""WITH {SECTIONS}, r AS (SELECT session_id, command, max(seq) AS spot, max_by(is_failure, seq) AS bad, max_by(result, seq) AS result FROM n WHERE category IN ('test', 'build') GROUP BY ALL)
SELECT session_id, string_agg(command || ':' || CASE WHEN bad THEN 'failed' ELSE 'passed' END || ':' || result, chr(10) ORDER BY spot) AS tests FROM r GROUP BY 1 UNION ALL SELECT session_id, '' FROM c WHERE test_runs = 0""")
def d14_validation(spark, d):
    v = memory.validation(logs.normalised(spark, d))
    lines = F.transform("tests", lambda t: F.concat_ws(":", t["command"], t["status"], t["output_summary"]))
    return v.select("session_id", F.coalesce(joined(lines, "\n"), F.lit("")).alias("tests"))


_ISSUES = f"""{SECTIONS},
rep AS (SELECT session_id, error, count(*) AS times, min(seq) AS first_seq, row_number() OVER (PARTITION BY session_id ORDER BY min(seq)) AS nth FROM f WHERE category IN {_TOOLS} AND length(error) >= 12 GROUP BY session_id, error HAVING count(*) >= 3),
i AS (SELECT session_id, 1 AS source, seq AS spot, CASE WHEN category IN ('test', 'build') THEN '{LABEL["issue_test"]}' ELSE '{LABEL["issue_command"]}' END || error AS description, CASE WHEN category IN ('test', 'build') THEN 'high' ELSE 'medium' END AS priority, {_CUT("command", 200)} AS context FROM open WHERE coalesce(kind, '') <> 'turn_aborted'
UNION ALL SELECT session_id, 2, seq, '{LABEL["issue_interrupted"]}', 'medium', reason FROM n WHERE kind = 'turn_aborted'
UNION ALL SELECT session_id, 3, 0, '{LABEL["issue_no_path"]}' || cwd, 'high', cwd FROM p WHERE NOT there
UNION ALL SELECT session_id, 3, 0, '{LABEL["issue_no_git"]}', 'low', cwd FROM p WHERE there AND NOT is_git
UNION ALL SELECT session_id, 4, first_seq, {say("issue_repeated", "times")} || error, 'high', NULL FROM rep WHERE nth <= 2),
j AS (SELECT *, {_KEY("description", 40)} AS key FROM i),
once AS (SELECT session_id, key, min_by(description, (source, spot)) AS description, min_by(priority, (source, spot)) AS priority, min((source, spot)) AS o FROM j GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o) AS nth FROM once)"""


@query(f"WITH {_ISSUES} SELECT session_id, nth, description, priority FROM ranked WHERE nth <= 6")
def d3_unresolved(spark, d):
    return memory.unresolved(logs.normalised(spark, d), logs.project(spark, d)).select("session_id", "nth", "description", "priority")


@query(f"""WITH {SECTIONS}, o AS (SELECT *, {_KEY("action", 40)} AS key FROM open WHERE coalesce(kind, '') <> 'turn_aborted' AND (command IS NOT NULL OR path IS NOT NULL)),
g AS (SELECT session_id, key, min(seq) AS seq FROM o GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM g),
a AS (SELECT r.session_id, nth, '{LABEL["action_fix"]}' || action || {say("action_error", "error")} AS action FROM r JOIN o USING (session_id, seq) WHERE nth <= 8)
SELECT * FROM a UNION ALL SELECT session_id, 1, '{LABEL["action_default"]}' FROM c WHERE session_id NOT IN (SELECT session_id FROM a)""")
def d4_next_actions(spark, d):
    return memory.next_actions(logs.normalised(spark, d)).select("session_id", "nth", "action")


@query(f"""WITH {_ISSUES} SELECT p.session_id, concat_ws('|', CASE WHEN p.session_id IN (SELECT session_id FROM rep) THEN '{RISKS['repeated'][0]}' END, CASE WHEN is_git AND n_changed > 0 THEN replace('{RISKS['uncommitted'][0]}', '{{}}', CAST(n_changed AS VARCHAR)) END,
CASE WHEN NOT there THEN '{RISKS['no_path'][0]}' END) AS risks FROM p""")
def d5_risks(spark, d):
    r = memory.risks(logs.normalised(spark, d), logs.project(spark, d))
    return r.select("session_id", joined(F.transform("risks", lambda x: x["description"]), "|").alias("risks"))


_BLOCK = f"""CASE WHEN type = 'user_message' THEN length({_CUT(_STRIP.format("content"), 500)}) + 15 WHEN is_failure THEN length(CASE WHEN type = 'error' THEN content ELSE error END) + 15
  WHEN type = 'test' THEN length(result) + 15 ELSE 0 END"""


@query(f"""WITH {N},
s AS (SELECT session_id, count(*) AS n_reads, max(seq) AS last_seq, max_by(ts, seq) AS last_ts, max_by(is_failure, seq) AS bad FROM n WHERE category = 'file_read' GROUP BY 1 HAVING count(*) > 3),
o AS (SELECT n.session_id, seq, type, category, is_failure FROM n LEFT JOIN s USING (session_id) WHERE n_reads IS NULL OR category <> 'file_read'),
a AS (SELECT * FROM o UNION ALL SELECT session_id, last_seq, 'file_read', 'file_read', bad FROM s),
l AS (SELECT *, CASE category WHEN 'user_message' THEN 20 WHEN 'assistant_message' THEN 25 WHEN 'reasoning' THEN 6 WHEN 'meta' THEN 1 WHEN 'file_read' THEN 1000000 ELSE 150 END AS most,
  row_number() OVER (PARTITION BY session_id, category, is_failure OR type = 'error' ORDER BY seq) AS nth FROM a)
SELECT i.session_id, n_input, coalesce(n_reads, 0) AS n_reads, kept, dropped FROM (SELECT session_id, count(*) AS n_input FROM n GROUP BY 1) i LEFT JOIN s USING (session_id)
JOIN (SELECT session_id, count(*) FILTER (is_failure OR type = 'error' OR nth <= most) AS kept, count(*) FILTER (NOT (is_failure OR type = 'error' OR nth <= most)) AS dropped FROM l GROUP BY 1) USING (session_id)""")
def c1_compressed(spark, d):
    """With a budget that nothing exceeds; the tiers that a budget drops have a query and tests of their own."""
    b = compress.bundles(logs.normalised(spark, d), 10_000_000)
    at = lambda k: F.element_at("stats", k)
    return b.select("session_id", at("input_events").alias("n_input"), at("_file_read_aggregated").alias("n_reads"), at("kept_events").alias("kept"), at("dropped").alias("dropped"))


@query(None)
def d1_memory_document(spark, d):
    n = logs.normalised(spark, d)
    doc = memory.reconstruct(n, logs.sessions(spark, d), logs.project(spark, d), keep=written)
    return doc.select("session_id", F.to_json(F.struct("*")).alias("document"))


@query(None)
def g1_markdown(spark, d):
    n = logs.normalised(spark, d)
    return render.as_markdown(memory.reconstruct(n, logs.sessions(spark, d), logs.project(spark, d), keep=written))
