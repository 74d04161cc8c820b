"""The registered queries of the session log engine, each beside its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregate as A
from ..operators import classify, compress, document, memory, pairing, render, revise
from . import logs
from .logs import matches
from .testdata import MESSAGES_SQL as M
from .testdata import TOOL_SQL as T
from .testdata import TOOLS, messages, table, tool_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
L = lambda c: F.col(c).cast("long").alias(c)


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _calls(spark, d):
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "result")
    return tool_events(spark, d).select("session_id", "seq", kind.alias("kind"), F.col("k").alias("call_id"), "value").filter("kind is not null")


_CALLS = f"""{T},
c AS (SELECT session_id, seq, CASE event_type WHEN 'click' THEN 'call' ELSE 'result' END AS kind, k AS call_id, value
      FROM t WHERE event_type IN ('click', 'view')),
p AS (SELECT *, CASE WHEN kind = 'result' THEN max(CASE WHEN kind = 'call' THEN seq END) OVER
        (PARTITION BY session_id, call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS call_seq FROM c)"""


@query(f"""WITH {T}, {M}
SELECT 'chat' AS agent, session_id, seq, role || '_message' AS type, CAST(length(content) AS BIGINT) AS n_chars FROM m
UNION ALL SELECT 'tools', session_id, seq, 'tool_call', CAST(length(command) AS BIGINT) FROM t""")
def u1_event_union(spark, d):
    chat = messages(spark, d).select(F.lit("chat").alias("agent"), "session_id", "seq", "type", F.length("content").cast("long").alias("n_chars"))
    tools = tool_events(spark, d).select(F.lit("tools").alias("agent"), "session_id", "seq", "type", F.length("command").cast("long").alias("n_chars"))
    return chat.unionByName(tools)


_STRIP = "regexp_replace(regexp_replace(coalesce({0}, ''), '^" + X.SPACE.replace("{", "{{").replace("}", "}}") + "+', ''), '" + X.SPACE.replace("{", "{{").replace("}", "}}") + "+$', '')"


@query(f"""SELECT doc_id FROM (SELECT doc_id, length(s) AS n, row_number() OVER (PARTITION BY lang, source, s ORDER BY doc_id) AS rn
FROM (SELECT *, {_STRIP.format('text')} AS s FROM documents)) WHERE n <= 40 OR rn = 1""")
def w1_message_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "text", F.col("doc_id").alias("seq"))
    return A.dedup_messages(docs, ["lang", "source"], "text").select("doc_id")


_ROLLUP = f"""WITH {T}, {M},
e AS (SELECT 'chat' AS agent, session_id, role || '_message' AS type, false AS is_failure FROM m
      UNION ALL SELECT 'tools', session_id, 'tool_call', is_failure FROM t),
r AS (SELECT agent, session_id, count(*) FILTER (type = 'user_message') AS n_user, count(*) FILTER (type = 'assistant_message') AS n_assistant,
        count(*) FILTER (type = 'tool_call') AS n_tools, count(*) FILTER (is_failure) AS n_failures FROM e GROUP BY ALL)
"""


def _rollup(spark, d):
    chat = messages(spark, d).select("session_id", "type", F.lit(False).alias("is_failure"))
    tools = tool_events(spark, d).select("session_id", "type", "is_failure")
    return A.session_rollup(chat).select(F.lit("chat").alias("agent"), "*").unionByName(A.session_rollup(tools).select(F.lit("tools").alias("agent"), "*"))


@query(_ROLLUP + "SELECT * FROM r")
def a2_session_rollup(spark, d):
    return _rollup(spark, d).drop("confidence")


@query(_ROLLUP + """SELECT agent, session_id, CASE WHEN n_user + n_assistant + n_tools = 0 THEN 'unknown' WHEN n_user = 0 THEN 'low'
WHEN n_user + n_assistant + n_tools < 8 THEN 'low' ELSE 'medium' END AS confidence FROM r""")
def a3_confidence(spark, d):
    return _rollup(spark, d).select("agent", "session_id", "confidence")


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'terminal' WHEN 'view' THEN 'file_read' WHEN 'purchase' THEN 'file_edit'
WHEN 'signup' THEN 'plan' ELSE 'tool_call' END AS category FROM events""")
def j14_tool_category(spark, d):
    tool = F.element_at(F.create_map(*[F.lit(x) for p in TOOLS.items() for x in p]), F.col("event_type"))
    return table(spark, d, "events").select("event_id", classify.tool_category(tool).alias("category"))


_TEST, _BUILD, _LINT, _SEARCH = (matches("full_command", p) for p in (classify.TEST, classify.BUILD, classify.LINT, classify.SEARCH))


@query(f"""WITH {T} SELECT event_id, {_TEST} AS is_test, NOT {_TEST} AND {_BUILD} AS is_build, {_LINT} AS is_lint FROM t""")
def f7_f8_f9_command_class(spark, d):
    return tool_events(spark, d).select("event_id", *classify.command_class(F.col("full_command")))


@query(f"""WITH {T} SELECT event_id, exit_code = 1 AND {_SEARCH} AS expected FROM t""")
def f10_expected_nonzero(spark, d):
    return tool_events(spark, d).select("event_id", classify.expected_nonzero(F.col("full_command"), F.col("exit_code")).alias("expected"))


#: What a tool said, by k: {c} is the exit code and {e} the error line.
_SAID = [
    "Exit code: {c}", "done\nProcess exited with code {c}", "it exited with code -{c}", "reading\n{e}", "all fine\nmissing nothing", "a\nb\nc\nerror on line four",
    "sh: foo: command not found", "Exit code: {c}\nProcess exited with code 7", "1\n2\nPermission denied",
]


def _output(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), F.col("k") % len(_SAID) + 1)
    filled = F.replace(F.replace(said, F.lit("{c}"), F.col("exit_code").cast("string")), F.lit("{e}"), F.col("error"))
    return tool_events(spark, d).withColumn("output", filled)


_OUTPUT = f"""WITH {T},
o AS (SELECT *, replace(replace([{", ".join("'" + x.replace(chr(10), "' || chr(10) || '") + "'" for x in _SAID)}][k % {len(_SAID)} + 1], '{{c}}', exit_code::VARCHAR), '{{e}}', error) AS output FROM t),
c AS (SELECT *, CAST(coalesce({", ".join(f"nullif(regexp_extract(output, '{p}', 1), '')" for p in X.EXIT_CODES)}) AS INTEGER) AS code FROM o)
"""


@query(_OUTPUT + "SELECT event_id, code FROM c")
def f5_exit_code(spark, d):
    return _output(spark, d).select("event_id", X.exit_code(F.col("output")).alias("code"))


@query(_OUTPUT + f"""SELECT event_id, CASE WHEN code IS NOT NULL THEN code <> 0 ELSE {matches("left(output, 600)", X.STRONG_FAILURE)}
OR {matches("array_to_string(string_split(left(output, 600), chr(10))[1:3], chr(10))", X.FAILURE_HINT)} END AS failed FROM c""")
def f6_failure(spark, d):
    return _output(spark, d).select("event_id", X.looks_failed(X.exit_code(F.col("output")), F.col("output")).alias("failed"))


@query(f"""WITH {T}, n AS (SELECT *, CASE WHEN {_TEST} THEN 'test' WHEN {_BUILD} THEN 'build' ELSE 'terminal' END AS cat,
is_failure AND NOT ({_SEARCH}) AS failed FROM t)
SELECT session_id, cat AS category, count(*) AS n, CAST(count(*) FILTER (failed) AS BIGINT) AS n_failed FROM n GROUP BY ALL""")
def n8_normalised_calls(spark, d):
    calls = tool_events(spark, d).withColumn("tool_name", F.lit("shell")).withColumn("command", F.col("full_command"))
    return classify.normalise_calls(calls).groupBy("session_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_failure").alias("n_failed"))


@query(f"""WITH {_CALLS},
r AS (SELECT session_id, call_seq AS seq, count(*) AS n_results, max(seq) AS result_seq, max_by(value, seq) AS value FROM p WHERE call_seq IS NOT NULL GROUP BY ALL)
SELECT c.session_id, c.seq, c.call_id, coalesce(n_results, 0) AS n_results, result_seq, r.value FROM c LEFT JOIN r USING (session_id, seq) WHERE kind = 'call'
UNION ALL SELECT session_id, seq, call_id, 0, seq, value FROM p WHERE kind = 'result' AND call_seq IS NULL""")
def j2_pair_calls(spark, d):
    return pairing.pair_calls(_calls(spark, d))


@query(f"WITH {_CALLS} SELECT session_id, count(*) AS n_unmatched FROM p WHERE kind = 'result' AND call_seq IS NULL GROUP BY 1")
def j3_unmatched_results(spark, d):
    return pairing.unmatched_results(_calls(spark, d))


_RESOLVED = """resolved AS (SELECT f.*, EXISTS (SELECT 1 FROM t g WHERE g.session_id = f.session_id AND g.command = f.command AND NOT g.is_failure AND g.ts > f.ts) AS resolved
FROM t f WHERE is_failure)"""


@query(f"WITH {T}, {_RESOLVED} SELECT event_id, resolved FROM resolved")
def j4_resolved_later(spark, d):
    return pairing.resolved_later(tool_events(spark, d)).select("event_id", "resolved")


@query(f"""WITH {T} SELECT event_id, n_others FROM (SELECT event_id, count(*) OVER (PARTITION BY session_id, error) - 1 AS n_others FROM t WHERE is_failure) WHERE n_others >= 2""")
def j5_same_error(spark, d):
    return pairing.same_error(tool_events(spark, d)).select("event_id", "n_others")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6_missing_refs(spark, d):
    return pairing.missing_references(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT a.r_name AS source, b.r_name AS target FROM region a JOIN region b ON a.r_name <> b.r_name")
def j12_pairs(spark, d):
    return pairing.migration_pairs(table(spark, d, "region").select(F.col("r_name").alias("agent")))


_TAIL = "tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS back FROM t) WHERE back <= 15 AND is_failure)"


@query(f"WITH {T}, {_TAIL} SELECT event_id FROM tail")
def w3_tail_failures(spark, d):
    return A.tail_failures(tool_events(spark, d)).select("event_id")


@query(f"""WITH {T} SELECT session_id, string_agg(path, ',' ORDER BY seq) AS paths, count(*) AS n
FROM (SELECT session_id, path, min(seq) AS seq FROM t WHERE category = 'file_read' GROUP BY ALL) GROUP BY 1""")
def a4_read_paths(spark, d):
    return A.read_paths(tool_events(spark, d)).select("session_id", F.array_join("paths", ",").alias("paths"), F.size("paths").cast("long").alias("n"))


@query(f"""WITH {T} SELECT session_id, path, count(*) AS edits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed,
max_by(status, seq) FILTER (status IS NOT NULL) AS status, min(seq) AS first_seq FROM t WHERE category = 'file_edit' GROUP BY ALL""")
def a5_edited_rollup(spark, d):
    return A.edited_files(tool_events(spark, d))


@query(f"WITH {T} SELECT session_id, error, count(*) AS n, min(seq) AS first_seq FROM t WHERE is_failure GROUP BY ALL HAVING count(*) >= 3")
def a6_repeated_errors(spark, d):
    return A.repeated_errors(tool_events(spark, d))


@query(f"""WITH {T}, f AS (SELECT *, replace(command, '_', '') AS key FROM t WHERE is_failure),
g AS (SELECT session_id, key, min(seq) AS first_seq FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY first_seq) AS nth FROM g),
k AS (SELECT session_id, max(first_seq) FILTER (nth = 15) AS cut FROM r WHERE nth <= 15 GROUP BY 1)
SELECT r.session_id, r.key, r.nth, r.first_seq, count(*) AS n FROM r JOIN k USING (session_id) JOIN f ON f.session_id = r.session_id AND f.key = r.key AND (cut IS NULL OR f.seq <= cut)
WHERE nth <= 15 GROUP BY ALL""")
def a7_attempts(spark, d):
    return A.attempts(tool_events(spark, d)).select("session_id", "key", L("nth"), "first_seq", "n")


@query(f"""WITH {T} SELECT session_id, command, max(seq) AS seq, max_by(category, seq) AS category, max_by(is_failure, seq) AS is_failure, max_by(exit_code, seq) AS exit_code
FROM t WHERE category IN ('test', 'build') GROUP BY ALL""")
def a8_last_per_command(spark, d):
    return A.last_per_command(tool_events(spark, d))


@query(f"WITH {T} SELECT session_id, max(seq) AS seq, max_by(command, seq) AS command, max_by(is_failure, seq) AS is_failure FROM t WHERE category = 'build' GROUP BY 1")
def a9_last_build(spark, d):
    return A.last_build(tool_events(spark, d))


@query(f"""WITH {T}, g AS (SELECT session_id, command, min(seq) AS seq FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) AS nth FROM g)
SELECT session_id, string_agg(command, ',' ORDER BY seq) AS commands FROM r WHERE nth <= 20 GROUP BY 1""")
def a10_recent_commands(spark, d):
    return A.recent_commands(tool_events(spark, d)).select("session_id", F.array_join("commands", ",").alias("commands"))


@query(f"WITH {T} SELECT session_id, string_agg(full_command, ',' ORDER BY seq) AS commands FROM t WHERE {_LINT} GROUP BY 1")
def a11_lint(spark, d):
    lint = tool_events(spark, d).filter(classify.command_class(F.col("full_command"))[2])
    return lint.groupBy("session_id").agg(F.array_join(A.listed("full_command"), ",").alias("commands"))


_CUT = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 3}) || '...' END"
_END = X.TRAILING.replace("{", "{{").replace("}", "}}")
_BARE_END = f"regexp_replace(regexp_replace({_STRIP}, '^{_END}+', ''), '{_END}+$', '')"
_SENTENCE = f"""coalesce([x FOR x IN [{_BARE_END.format('y')} FOR y IN string_split_regex(coalesce(content, ''), '{X.SENTENCE_ENDS}')] IF length(x) >= 2][1], {_BARE_END.format('content')})"""
_KEY = lambda c, n: f"left(regexp_replace({c}, '{logs.quoted(X.KEY_IGNORES)}', '', 'g'), {n})"


@query(f"""WITH {M}, s AS (SELECT *, {_SENTENCE} AS full_sentence FROM m WHERE role = 'user'),
c AS (SELECT *, {_CUT('full_sentence', 120)} AS sentence FROM s), k AS (SELECT *, {_KEY('sentence', 50)} AS key FROM c),
g AS (SELECT session_id, key, min(seq) AS seq, min_by(sentence, seq) AS sentence FROM k GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth FROM g)
SELECT session_id, nth, seq, sentence FROM r WHERE nth <= 10""")
def a12_requirements(spark, d):
    events = messages(spark, d)
    return memory.requirements(events).select("session_id", "nth", "seq", F.col("line").alias("sentence"))


_WORDS = " (the|die|la|de) "


@query(f"""WITH {M}, p AS (SELECT session_id, seq, unnest(string_split_regex(content, '[。\n]')) AS part, generate_subscripts(string_split_regex(content, '[。\n]'), 1) AS pos FROM m WHERE role = 'assistant'),
s AS (SELECT session_id, seq, pos, {_STRIP.format("replace(" + _BARE_END.format('part') + ", '**', '')")} AS decision FROM p),
g AS (SELECT session_id, decision, min(seq * 100000 + pos) AS place FROM s WHERE length(decision) BETWEEN 12 AND 140 AND regexp_matches(decision, '{_WORDS}') AND NOT regexp_matches(decision, '[?？]') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS nth FROM g)
SELECT session_id, nth, decision FROM r WHERE nth <= 3""")
def a13_decisions(spark, d):
    return memory.decisions(messages(spark, d).withColumn("ts", F.lit(None).cast("timestamp")), _WORDS).select("session_id", "nth", "decision")


@query(f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, role ORDER BY seq) AS up, row_number() OVER (PARTITION BY session_id, role ORDER BY seq DESC) AS down FROM m),
s AS (SELECT session_id, 'first users' AS slice, seq FROM r WHERE role = 'user' AND up <= 2 UNION ALL
SELECT session_id, 'last users', seq FROM r WHERE role = 'user' AND down <= 2 UNION ALL SELECT session_id, 'last assistants', seq FROM r WHERE role = 'assistant' AND down <= 3)
SELECT session_id, slice, row_number() OVER (PARTITION BY session_id, slice ORDER BY seq) AS nth, seq FROM s""")
def w4_slices(spark, d):
    m = messages(spark, d)
    parts = [A.ends(m, r, k, last).select("session_id", F.lit(n).alias("slice"), L("nth"), "seq") for n, r, k, last in (("first users", "user", 2, False), ("last users", "user", 2, True), ("last assistants", "assistant", 3, True))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {T}, s AS (SELECT session_id, count(*) AS n, count(DISTINCT path) AS n_paths, max(ts) AS last_read, max_by(ts, seq) AS ts, max_by(is_failure, seq) AS is_failure, max(seq) AS seq
FROM t WHERE category = 'file_read' GROUP BY 1 HAVING count(*) > 3),
o AS (SELECT t.*, last_read FROM t LEFT JOIN s USING (session_id) WHERE s.session_id IS NULL OR category <> 'file_read')
SELECT session_id, seq, ts, category, is_failure, seq AS sort_seq, false AS is_summary, 1 AS n, 0 AS n_paths FROM o
UNION ALL SELECT session_id, seq, ts, 'file_read', is_failure, coalesce((SELECT max(seq) FROM o WHERE o.session_id = s.session_id AND o.ts <= s.last_read), 0), true, n, n_paths FROM s""")
def a16_file_read_collapse(spark, d):
    return compress.collapse_reads(tool_events(spark, d))


@query(f"""WITH {T} SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, category, is_failure ORDER BY seq) AS nth FROM t)
WHERE is_failure OR category NOT IN ('terminal', 'build', 'test', 'tool_call', 'tool_result', 'file_edit') OR nth <= 150""")
def w2_head_n(spark, d):
    return compress.head_per_category(tool_events(spark, d)).select("event_id")


def _text_query(name: str, column: Callable, sql: str | None) -> None:
    def run(spark, d):
        return table(spark, d, "documents").select("doc_id", column(F.col("text")).alias("out"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS out FROM (SELECT doc_id, text, coalesce(text, '') AS content FROM documents)" if sql else None)(run)


_FLAT = _STRIP.format("content")
_LINES = f"string_split_regex(content, '{X.LINE_ENDS}')"
_BARE = _STRIP.format("regexp_replace(regexp_replace(" + _STRIP.format("y") + ", '^#+', ''), '#+$', '')")
_FIRST_LINE = f"coalesce([x FOR x IN [{_BARE} FOR y IN {_LINES}] IF x <> ''][1], '')"
_PLAIN = _STRIP.format(r"regexp_replace(y, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')")
_ERROR_LINES = f"[x FOR x IN [{_PLAIN} FOR y IN {_LINES}] IF x <> '' AND NOT {matches('x', X.NOISE_LINE)}]"
_ERROR = f"""coalesce({", ".join(f"[x FOR x IN {_ERROR_LINES} IF regexp_matches(lower(x), '{X.any_of(words)}')][1]" for words in (X.STRONG_ERRORS, X.WEAK_ERRORS))}, '')"""
_CELL = "replace(replace(content, chr(10), ' '), '|', '\\|')"
_WIDE = "length(regexp_replace(content, '[^一-鿿]', '', 'g'))"
_text_query("x1_truncate", lambda c: X.truncate(c, 200), _CUT(_FLAT, 200))
_text_query("x2_collapse", lambda c: F.sha1(X.collapse(c)), "sha1(" + _STRIP.format(r"regexp_replace(regexp_replace(content, '[\x20\x09　]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')").replace("{{3,}}", "{3,}") + ")")
_text_query("x3_first_line", X.first_line, _CUT(_STRIP.format(_FIRST_LINE), 120))
_text_query("x4_tokens", X.estimate_tokens, f"CAST({_WIDE} + CASE WHEN length(content) > {_WIDE} THEN greatest(1, (length(content) - {_WIDE}) // 4) ELSE 0 END AS BIGINT)")
_text_query("x6_short_hash", X.short_hash, "left(sha1(content), 8)")
_SLUG = r"""regexp_replace(regexp_replace(regexp_replace({}, '[ /\\:*?"<>|.\n\t]', '-', 'g'), '[^\p{{L}}\p{{N}}_-]', '', 'g'), '-{{2,}}', '-', 'g')"""
_text_query("x7_slug", X.slug, f"coalesce(nullif(left(regexp_replace({_SLUG.format(_FLAT)}, '^-+|-+$', '', 'g'), 60), ''), 'item')")
_text_query("sk10_safe_name", X.safe_name, r"left(regexp_replace(content, '[^\p{L}\p{N}_.-]', '_', 'g'), 120)")
_text_query("x11_first_error_line", X.first_error_line, _CUT(_STRIP.format(_ERROR), 200))
_text_query("x14_first_sentence", X.first_sentence, _CUT(_STRIP.format(_SENTENCE), 60))
_text_query("x15_dedupe_key", lambda c: X.dedupe_key(c, 80), _KEY("content", 80))
_text_query("x28_table_cell", X.table_cell, f"CASE WHEN {_STRIP.format(_CELL)} = '' THEN '-' ELSE {_CUT(_STRIP.format(_CELL), 160)} END")
_text_query("x36_clip", lambda c: X.clip(c, 80), f"""CASE WHEN length({_STRIP.format("replace(content, chr(10), ' ')")}) <= 80 THEN {_STRIP.format("replace(content, chr(10), ' ')")} ELSE left({_STRIP.format("replace(content, chr(10), ' ')")}, 79) || '…' END""")
_text_query("x9_plain", X.strip_ansi, _STRIP.format(r"regexp_replace(content, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')"))
_ARGUMENT = "translate(" + _STRIP.format(f"regexp_replace(content, '{X.SPACE}+', ' ', 'g')") + ", '%&|<>^\"`', '％＆｜＜＞＾''｀')"
_text_query("x29_shell_argument", X.shell_argument, f"CASE WHEN length({_ARGUMENT}) <= 600 THEN {_ARGUMENT} ELSE left({_ARGUMENT}, 599) || '…' END")


@query("""SELECT doc_id AS session_id, unnest(['lang', 'source', 'text']) AS "check", unnest([CASE WHEN trim(coalesce(lang, '')) IN ('', 'unknown') THEN 'error' ELSE 'ok' END,
CASE WHEN trim(coalesce(source, '')) IN ('', 'unknown') THEN 'error' ELSE 'ok' END, CASE WHEN trim(coalesce(text, '')) IN ('', 'unknown') THEN 'error' ELSE 'ok' END]) AS level FROM documents""")
def d8_required(spark, d):
    return document.required_fields(table(spark, d, "documents").withColumnRenamed("doc_id", "session_id"), ["lang", "source", "text"])


@query(f"""WITH {T}, {_RESOLVED}, done AS (SELECT session_id, string_agg(DISTINCT command, chr(10)) AS blob FROM t WHERE NOT is_failure GROUP BY 1)
SELECT event_id FROM t LEFT JOIN done USING (session_id) WHERE is_failure AND NOT contains(coalesce(blob, ''), left(lower(command), 16))""".replace(f", {_RESOLVED}", ""))
def u4_todo_overlap(spark, d):
    e = tool_events(spark, d)
    done = e.filter("not is_failure").groupBy("session_id").agg(F.collect_set("command").alias("completed"))
    return memory.without_completed(e.filter("is_failure").withColumn("action", F.col("command")), done).select("event_id")


_DIFF = f"""WITH {T}, s AS (SELECT session_id, count(*) AS events, count(DISTINCT k) AS commands, count(*) FILTER (is_failure) AS failures FROM t GROUP BY 1),
q AS (SELECT session_id, count(*) AS events, count(DISTINCT k) AS commands, count(*) FILTER (is_failure) AS failures FROM t WHERE event_type <> 'error' GROUP BY 1),
a AS (UNPIVOT s ON events, commands, failures INTO NAME field VALUE a), b AS (UNPIVOT q ON events, commands, failures INTO NAME field VALUE b),
x AS (SELECT session_id, field, a, b, CASE WHEN a IS NOT DISTINCT FROM b THEN 'same' ELSE coalesce(printf('%+d', b - a), 'different') END AS state FROM a FULL JOIN b USING (session_id, field)) """


def _diff(spark, d):
    def snap(e):
        sums = e.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("k").alias("commands"), F.count_if("is_failure").alias("failures"))
        return revise.tall(sums, {f"{c}（条）": F.col(c).cast("string") for c in ("events", "commands", "failures")})

    e = tool_events(spark, d)
    return revise.compared(snap(e), snap(e.filter("event_type != 'error'")))


@query(_DIFF.replace("printf('%+d', b - a)", "CASE WHEN b > a THEN '+' ELSE '' END || (b - a)") + "SELECT * FROM x")
def j10_field_diff(spark, d):
    state = F.when(F.col("delta") == "一致", "same").when(F.col("delta") == "不同", "different").otherwise(F.col("delta"))
    return _diff(spark, d).select("session_id", F.regexp_replace("field", "（条）$", "").alias("field"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), state.alias("state"))


@query(_DIFF.replace("printf('%+d', b - a)", "CASE WHEN b > a THEN '+' ELSE '' END || (b - a)") + "SELECT session_id, bool_and(state = 'same') AS invariant, count(*) FILTER (state <> 'same') AS n_changed FROM x GROUP BY 1")
def d12_invariance(spark, d):
    return revise.facts_agree(_diff(spark, d))


@query("SELECT user_id AS session_id, max(ts) AS updated FROM events GROUP BY 1 ORDER BY updated DESC, session_id LIMIT 20")
def o1_recent_sessions(spark, d):
    """A listing: its limit is the feature."""
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated")).orderBy(F.desc("updated"), "session_id").limit(20)


@query(f"""WITH RECURSIVE {M}, n AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS nth, length(content) AS size FROM m),
w AS (SELECT session_id, 0 AS nth, 0 AS used, '' AS kept FROM (SELECT DISTINCT session_id FROM n) UNION ALL
SELECT w.session_id, n.nth, CASE WHEN used + size <= 600 THEN used + size ELSE used END, CASE WHEN used + size <= 600 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || n.nth ELSE kept END
FROM w JOIN n ON n.session_id = w.session_id AND n.nth = w.nth + 1)
SELECT session_id, CAST(max_by(used, nth) AS BIGINT) AS used, max_by(kept, nth) AS kept FROM w GROUP BY 1""")
def o9_block_packing(spark, d):
    from pyspark.sql import Window as W

    m = messages(spark, d).select("session_id", F.row_number().over(W.partitionBy("session_id").orderBy("seq")).alias("nth"), F.col("content").alias("block"))
    chunk = F.struct("nth", F.length("block").alias("size"), F.array(F.col("nth").cast("string")).alias("lines"))
    fitting = m.groupBy("session_id").agg(render.packed(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: F.struct(x["size"], x["lines"])), 600).alias("p"))
    return fitting.select("session_id", F.col("p.used").cast("long").alias("used"), F.array_join("p.kept", ",").alias("kept"))


@query("""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)""")
def j6_contains_join(spark, d):
    """Benchmark passages inside documents.  Documents are joined by their hashed four-word grams with words two to five
    of a passage first; passages under six words, whose last word may be cut off among these, are looked for as they are."""
    words = lambda c: F.split(c, r"[\x20\x09-\x0D]+")
    b = table(spark, d, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("passage"), F.size(words(F.col("text"))).alias("n"))
    head = F.array_join(F.slice(words(F.col("passage")), 2, 4), " ")
    keyed = b.filter("n >= 6").withColumn("key", F.xxhash64(head))
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text")
    w = words(F.col("text"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 3)), lambda i: F.xxhash64(F.array_join(F.slice(w, i, 4), " "))))
    posted = docs.select(F.col("doc_id").alias("id"), F.explode(grams).alias("key"))  # ids and hashes alone are shuffled
    pairs = posted.join(keyed.select("item_id", "key"), "key").select("id", "item_id").distinct()
    inside = F.contains("text", F.col("passage"))
    found = docs.join(pairs, F.col("doc_id").eqNullSafe(F.col("id"))).join(keyed.select("item_id", "passage"), "item_id").filter(inside)
    short = docs.join(b.filter("n < 6"), inside)
    return found.select("doc_id", "item_id").unionByName(short.select("doc_id", "item_id")).distinct()


from . import log_queries, patch_queries  # noqa: E402, F401  (add the queries over logs)
