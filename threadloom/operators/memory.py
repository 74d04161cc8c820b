"""The sections of a session's state document, over normalised events.

Each section is an aggregate keyed by session, combined before its shuffle where its result allows it; documents are
the sections joined by session.  project(session_id, cwd, exists, is_git, constraints, n_changed) holds what is known
of the session's project, one row per session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..fixed import ACTION_LEAD, DECISION, LABEL, LINT_COMMANDS, LIST_ITEM, PENDING, RISKS, SHOWN
from ..functions import text as X
from ..functions.tables import united
from . import aggregate as A
from . import compress

SESSION, TAIL = A.SESSION, 15
#: Tokens of a digest: so many times a document's, or so many where digests aren't compressed.
DIGEST_TIMES, UNCOMPRESSED = 3, 200_000
TOOLS = ["terminal", "file_edit", "file_read", "build", "test", "tool_call"]
CAPS = {"requirements": 10, "attempts": 15, "decisions": 3, "issues": 6, "actions": 8, "constraints": 8, "key_points": 8, "risks": 5}


def is_interrupt() -> Column:
    return (F.col("type") == "error") & (F.coalesce("kind", F.lit("")) == "turn_aborted")


def is_test() -> Column:
    return F.col("category").isin("test", "build")


def action_label() -> Column:
    """What an event tried: the file that it edits or reads, else its command, else its summary."""
    first, n = F.get("paths", F.lit(0)), F.size("paths")
    more = F.when(n > 1, X.filled(LABEL["more_files"], n)).otherwise("")
    return (
        F.when((F.col("category") == "file_edit") & (n > 0), F.concat(F.lit(LABEL["edit"]), X.truncate(first, 160), more))
        .when((F.col("category") == "file_read") & (n > 0), F.concat(F.lit(LABEL["read"]), X.truncate(first, 160)))
        .when(F.coalesce("command", F.lit("")) != "", X.truncate(F.col("command"), 200))
        .otherwise(X.truncate(F.coalesce(F.nullif("summary", F.lit("")), F.lit(LABEL["no_action"])), 200))
    )


def failures(events: DataFrame) -> DataFrame:
    """The failed tool events with their label and error line, and `resolved`: the same command succeeded at a later time."""
    marked = events.filter("is_failure").withColumns({"action": action_label(), "error": X.first_error_line(F.col("result"), 240), "key": F.nullif(X.strip(F.col("command")), F.lit(""))})
    fine = events.filter("not is_failure and command is not null").groupBy(SESSION, X.strip(F.col("command")).alias("key")).agg(F.max("ts").alias("last_ok"))
    return marked.join(fine, [SESSION, "key"], "left").withColumn("resolved", F.coalesce(F.col("last_ok") > F.col("ts"), F.lit(False))).drop("key", "last_ok")


def first_seen(rows: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first row of each key of a session, the first `most` keys, with nth from 1."""
    once = rows.filter(F.col(key) != "").groupBy(SESSION, key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (SESSION, key)]), F.struct(*order)).alias("r"), F.min(F.struct(*order)).alias("o"))
    ranked = once.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy("o"))).filter(F.col("nth") <= most)
    return ranked.select(SESSION, key, "r.*", F.col("nth").cast("long").alias("nth"))


def counts(events: DataFrame) -> DataFrame:
    """One row per session: what it holds, how it ended and how far it can be trusted."""
    tool = F.col("category").isin(TOOLS)
    paths = events.filter("category = 'file_edit'").select(SESSION, F.explode("paths").alias("path")).groupBy(SESSION).agg(F.count_distinct("path").alias("edited_files"))
    reads = events.filter("category = 'file_read'").select(SESSION, F.explode("paths").alias("path")).groupBy(SESSION).agg(F.count_distinct("path").alias("read_files"))
    whole = events.groupBy(SESSION).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("type") == "user_message").alias("user_messages"),
        F.count_if(tool).alias("tool_calls"),
        F.count_if(tool & F.col("is_failure")).alias("failures"),
        F.count_if(is_test()).alias("test_runs"),
        F.bool_or(is_interrupt()).alias("interrupted"),
        F.max_by((F.col("type") == "assistant_message") & (F.coalesce("kind", F.lit("")) == "task_complete"), "seq").alias("ended_clean"),
    )
    signals = F.col("user_messages") + F.col("tool_calls")
    confidence = F.when(signals == 0, "unknown").when((F.col("user_messages") == 0) | (signals < 8), "low").otherwise("medium")
    joined = whole.join(paths, SESSION, "left").join(reads, SESSION, "left")
    return joined.na.fill(0, ["edited_files", "read_files"]).withColumn("confidence", confidence)


def open_failures(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Failures of any category among a session's last events that no later success of their command resolves.

    Here and below, what several sections need may be handed over, as a table: failed (failures), late (these) and totals (counts).
    """
    back = F.row_number().over(W.partitionBy(SESSION).orderBy(F.desc("seq")))
    tail = events.withColumn("back", back).filter(F.col("back") <= TAIL).filter("is_failure").select(SESSION, "seq")
    return (failures(events) if failed is None else failed).join(tail, [SESSION, "seq"]).filter("not resolved")


def status(events: DataFrame, totals: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """session_id, status."""
    n_open = (open_failures(events) if late is None else late).groupBy(SESSION).agg(F.count(F.lit(1)).alias("n_open"))
    rows = (counts(events) if totals is None else totals).join(n_open, SESSION, "left")
    state = (
        F.when(F.col("interrupted"), "in_progress")
        .when(F.coalesce("n_open", F.lit(0)) > 0, "blocked")
        .when(F.col("ended_clean") & (F.col("failures") == 0), "completed")
        .otherwise("in_progress")
    )
    return rows.select(SESSION, state.alias("status"))


def requirements(events: DataFrame) -> DataFrame:
    said = events.filter("type = 'user_message'").withColumn("line", X.first_sentence(X.clean_user_text(F.col("content")), 120))
    return first_seen(said.select(SESSION, "seq", "line", X.dedupe_key(F.col("line"), 50).alias("key")), "key", ["seq"], CAPS["requirements"]).select(SESSION, "nth", "seq", "line")


def goals(events: DataFrame) -> DataFrame:
    """session_id, title, goal: the first request, with the last one where the first says little."""
    users = events.filter("type = 'user_message'").groupBy(SESSION).agg(F.min_by("content", "seq").alias("first"), F.max_by("content", "seq").alias("last"))
    flat = lambda c: X.strip(F.regexp_replace(c, r"\s*\n\s*", " "))
    cleaned = events.select(SESSION).distinct().join(users, SESSION, "left").withColumns({"first": X.clean_user_text(F.col("first")), "last": X.clean_user_text(F.col("last"))})
    rows = cleaned.withColumns({"goal": X.truncate(flat(F.col("first")), 400), "last": flat(F.col("last")), "title": X.first_sentence(F.col("first"), 60)})
    added = F.when(F.col("goal") != "", X.truncate(F.concat("goal", X.filled(LABEL["later_request"], F.col("last"))), 400)).otherwise(X.truncate(F.col("last"), 400))
    short = (F.length("goal") < 60) & (F.col("last") != "") & (X.dedupe_key(F.col("last"), 40) != X.dedupe_key(F.col("goal"), 40))
    goal = F.when(short, added).otherwise(F.col("goal"))
    return rows.select(SESSION, F.when(F.col("title") == "", LABEL["untitled"]).otherwise(F.col("title")).alias("title"), F.when(goal == "", "unknown").otherwise(goal).alias("goal"))


def ends(events: DataFrame, kind: str, first: int, last: int) -> DataFrame:
    """session_id, heads, tails: the contents of the first and the last messages of a type, in order.  Ranks limit rows before they are gathered."""
    own = events.filter(F.col("type") == kind).select(SESSION, "seq", "content")
    up, down = (F.row_number().over(W.partitionBy(SESSION).orderBy(o)) for o in (F.asc("seq"), F.desc("seq")))
    rows = own.withColumns({"up": up, "down": down}).filter((F.col("up") <= first) | (F.col("down") <= last))
    kept = lambda c, n: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= n, F.struct("seq", "content")))), lambda s: s["content"])
    return rows.groupBy(SESSION).agg(kept("up", first).alias("heads"), kept("down", last).alias("tails"))


def conversation(events: DataFrame, sessions: DataFrame, truncated: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """session_id, summary, key_points, user_preferences (none: only a patch knows any), important_messages.  sessions has session_id and cwd, truncated the ids of compressed ones."""
    users = ends(events, "user_message", 3, 2).withColumnsRenamed({"heads": "u_heads", "tails": "u_tails"})
    replies = ends(events, "assistant_message", 0, 3).select(SESSION, F.col("tails").alias("a_tails"))
    totals = counts(events) if totals is None else totals
    rows = totals.join(sessions.select(SESSION, "cwd"), SESSION, "left").join(users, SESSION, "left").join(replies, SESSION, "left")
    cut = F.lit(False)
    if truncated is not None:
        rows = rows.join(truncated.select(SESSION, F.lit(True).alias("is_cut")), SESSION, "left")
        cut = F.coalesce("is_cut", F.lit(False))
    none = F.array().cast("array<string>")
    lines = lambda c: F.filter(F.transform(c, lambda x: X.first_line(x, 140)), lambda x: x != "")
    rows = rows.withColumns(
        {
            "asked": F.array_distinct(lines(F.concat(F.slice(F.coalesce("u_heads", none), 1, 2), F.coalesce("u_tails", none)))),
            "told": lines(F.coalesce("a_tails", none)),
        }
    )
    told = F.transform(F.filter("told", lambda x: ~F.array_contains("asked", x)), lambda x: F.concat(F.lit(LABEL["conclusion"]), x))
    notes = F.when(cut, F.array(F.lit(LABEL["compressed"]))).otherwise(none)
    folder = F.when(F.coalesce("cwd", F.lit("")) != "", X.filled(LABEL["summary_folder"], F.col("cwd"))).otherwise("")
    return rows.select(
        SESSION,
        F.concat(folder, X.filled(LABEL["summary"], *[F.col(c) for c in ("user_messages", "tool_calls", "failures", "edited_files")])).alias("summary"),
        F.slice(F.concat("asked", told, notes), 1, CAPS["key_points"]).alias("key_points"),
        none.alias("user_preferences"),
        F.transform(F.filter(F.coalesce("u_heads", none), lambda x: x != ""), lambda x: X.truncate(X.collapse(x), 300)).alias("important_messages"),
    )


def edited_files(events: DataFrame) -> DataFrame:
    """session_id, path, edits, hunks, added, removed, status, first_seq, summary: a path counts as often as it is named."""
    each = events.filter("category = 'file_edit'").select(SESSION, "seq", F.posexplode("paths").alias("pos", "path"), "files")
    f = F.get(F.filter("files", lambda x: x["path"] == F.col("path")), F.lit(0))
    rows = each.select(SESSION, "path", F.struct("seq", "pos").alias("at"), F.col("seq"), f.alias("f"))
    total = lambda c: F.coalesce(F.sum(F.col(f"f.{c}")), F.lit(0)).alias(c)
    known = F.max_by("f.status", F.when(F.col("f.status").isNotNull(), F.col("at")))
    out = rows.groupBy(SESSION, "path").agg(
        F.count(F.lit(1)).alias("edits"), total("hunks"), total("added"), total("removed"), F.coalesce(known, F.lit("modified")).alias("status"), F.min("at").alias("first")
    )
    verb = F.when(F.col("status").isin("added", "deleted"), F.element_at(F.create_map(*[F.lit(x) for pair in SHOWN["file"].items() for x in pair]), F.col("status"))).otherwise(SHOWN["file"]["modified"])
    told = X.filled(LABEL["edit_summary"], *[F.col(c) for c in ("hunks", "added", "removed", "edits")])
    return out.withColumn("summary", F.when(F.col("hunks") > 0, told).otherwise(X.filled(LABEL["edit_blind"], verb, F.col("edits"))))


def passing_tests(events: DataFrame, most: int = 3) -> DataFrame:
    """The last passing test and build runs of each session, with nth in order."""
    fine = events.filter(is_test() & ~F.col("is_failure")).select(SESSION, "seq", "command")
    late = fine.withColumn("down", F.row_number().over(W.partitionBy(SESSION).orderBy(F.desc("seq")))).filter(F.col("down") <= most)
    return late.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy("seq")).cast("long")).select(SESSION, "nth", "seq", "command")


def implementation(events: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """session_id, completed, modified_files, created_files, deleted_files."""
    none = F.array().cast("array<string>")
    files = edited_files(events).groupBy(SESSION).agg(A.listed(F.struct("path", "summary", "status"), "first").alias("modified_files"))
    passed = passing_tests(events).groupBy(SESSION).agg(A.listed(F.concat(F.lit(LABEL["passed_test"]), X.truncate(F.col("command"), 120)), "nth").alias("passed"))
    rows = (counts(events) if totals is None else totals).select(SESSION, "read_files").join(files, SESSION, "left").join(passed, SESSION, "left")
    rows = rows.withColumn("modified_files", F.coalesce("modified_files", F.array().cast("array<struct<path:string,summary:string,status:string>>")))
    names = F.array_join(F.transform(F.slice("modified_files", 1, 6), lambda f: f["path"]), "、")
    read = F.when(F.col("read_files") > 0, X.filled(LABEL["read_count"], F.col("read_files")))
    edited = F.when(F.size("modified_files") > 0, X.filled(LABEL["edit_count"], F.size("modified_files"), names))
    of = lambda s: F.transform(F.filter("modified_files", lambda f: f["status"] == s), lambda f: f["path"])
    return rows.select(
        SESSION, F.concat(F.array_compact(F.array(read, edited)), F.coalesce("passed", none)).alias("completed"), "modified_files",
        of("added").alias("created_files"), of("deleted").alias("deleted_files"),
    )


def decisions(events: DataFrame, verbs: str = DECISION) -> DataFrame:
    """session_id, nth, decision, ts: sentences of replies that state one and ask nothing."""
    parts = events.filter("type = 'assistant_message'").select(SESSION, "seq", "ts", F.posexplode(F.split("content", r"[。\n]")).alias("pos", "part"))
    sentence = X.strip(F.replace(X.without_trailing(F.col("part")), F.lit("**"), F.lit("")))
    s = parts.select(SESSION, "seq", "pos", "ts", sentence.alias("decision"))
    s = s.filter(F.length("decision").between(12, 140) & F.rlike("decision", F.lit(verbs)) & ~F.rlike("decision", F.lit("[?？]")))
    return first_seen(s, "decision", ["seq", "pos"], CAPS["decisions"]).select(SESSION, "nth", "decision", "ts")


def failure_result(error: Column) -> Column:
    """What came of a failed event: for a test or build that it failed, else its error line, with the exit code where there is none."""
    word = F.when(F.col("category") == "build", LABEL["build_word"]).otherwise(LABEL["test_word"])
    base = F.when(is_test(), F.concat(word, F.lit(LABEL["run_failed"]))).otherwise(LABEL["run_failed"])
    code = F.when((error == "") & F.col("exit_code").isNotNull(), X.filled(LABEL["exit_code"], F.col("exit_code"))).otherwise("")
    return F.when(~is_test() & (error != ""), X.truncate(error, 200)).otherwise(F.concat(base, code))


def attempts(events: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """session_id, nth, action, result, success, error, lesson: distinct failed actions, then the last passing tests."""
    failed = (failures(events) if failed is None else failed).filter(F.col("category").isin(TOOLS)).withColumn("short", X.truncate(F.col("error"), 160))
    same = failed.groupBy(SESSION, "short").agg(F.count(F.lit(1)).alias("n_same"))
    rows = failed.join(same, [SESSION, "short"]).withColumn("key", X.dedupe_key(F.col("action"), 80))
    repeated = (F.col("error") != "") & (F.col("error") == F.col("short")) & (F.col("n_same") - 1 >= 2)
    lesson = (
        F.when(F.col("resolved"), LABEL["lesson_resolved"])
        .when(repeated, LABEL["lesson_same"])
        .when(F.col("category") == "file_edit", LABEL["lesson_edit"])
    )
    told = rows.withColumns({"result": failure_result(F.col("error")), "lesson": lesson})
    firsts = told.groupBy(SESSION, "key").agg(F.min("seq").alias("first_seq"), F.min_by(F.struct("action", "result", "error", "lesson"), "seq").alias("r"))
    ranked = firsts.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy("first_seq")).cast("long")).filter(F.col("nth") <= CAPS["attempts"])
    cut = ranked.groupBy(SESSION).agg(F.max(F.when(F.col("nth") == CAPS["attempts"], F.col("first_seq"))).alias("cut"))
    n = told.join(cut, SESSION).filter("cut is null or seq <= cut").groupBy(SESSION, "key").agg(F.count(F.lit(1)).alias("n"))
    again = F.when(F.col("n") > 1, X.filled(LABEL["repeated"], F.col("n"))).otherwise("")
    bad = ranked.join(n, [SESSION, "key"]).select(
        SESSION, "nth", "r.action", F.concat("r.result", again).alias("result"), F.lit(False).alias("success"), F.nullif("r.error", F.lit("")).alias("error"), "r.lesson"
    )
    good = passing_tests(events).select(
        SESSION, (F.col("nth") + 1000).alias("nth"), X.truncate(F.coalesce(F.nullif("command", F.lit("")), F.lit(LABEL["run_tests"])), 200).alias("action"), F.lit(LABEL["fine"]).alias("result"),
        F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("lesson"),
    )
    return united(bad, good)


def run_summary(result: Column) -> Column:
    """What a test or build said: its error line when it failed, else its first line."""
    error = X.first_error_line(result, 240)
    code = F.when(F.col("exit_code").isNotNull(), F.concat(F.lit(LABEL["run_failed"]), X.filled(LABEL["exit_code"], F.col("exit_code")))).otherwise(LABEL["run_failed"])
    line = X.first_line(result, 160)
    return F.when(F.col("is_failure"), F.when(error != "", error).otherwise(code)).otherwise(F.when(line != "", line).otherwise(LABEL["fine"]))


def validation(events: DataFrame) -> DataFrame:
    """session_id, tests (the last run of each command), build (the last one), lint (all commands)."""
    runs = events.filter(is_test()).withColumns({"said": run_summary(F.col("result")), "state": F.when(F.col("is_failure"), "failed").otherwise("passed")})
    key = X.strip(F.col("command"))
    last = runs.groupBy(SESSION, key.alias("key")).agg(F.max("seq").alias("at"), F.max_by(F.struct("state", "said"), "seq").alias("r"))
    shown = X.truncate(F.when(F.col("key") == "", "unknown").otherwise(F.col("key")), 200).alias("command")
    tests = last.groupBy(SESSION).agg(A.listed(F.struct(shown, F.col("r.state").alias("status"), F.col("r.said").alias("output_summary"), F.lit("program").alias("source")), "at").alias("tests"))
    build = runs.filter("category = 'build'").groupBy(SESSION).agg(
        F.max_by(F.struct(X.truncate(F.col("command"), 200).alias("command"), F.col("state").alias("status"), F.col("said").alias("output_summary")), "seq").alias("build")
    )
    lint = events.filter(F.rlike("command", F.lit("(?i)" + "|".join(LINT_COMMANDS)))).groupBy(SESSION).agg(A.listed(X.truncate(F.col("command"), 200)).alias("lint"))
    return events.select(SESSION).distinct().join(tests, SESSION, "left").join(build, SESSION, "left").join(lint, SESSION, "left")


def repeated_errors(events: DataFrame, least: int = 3) -> DataFrame:
    """session_id, error, n, first_seq: error lines of 12 characters or more that `least` failures share."""
    failed = events.filter(F.col("is_failure") & F.col("category").isin(TOOLS)).select(SESSION, "seq", X.first_error_line(F.col("result"), 160).alias("error"))
    return failed.groupBy(SESSION, "error").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).filter((F.col("n") >= least) & (F.length("error") >= 12))


def unresolved(events: DataFrame, project: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """session_id, nth, description, priority, context, suspected_cause, from four sources in order."""
    text = F.lit(None).cast("string")
    issue = lambda source, at, what, priority, context, cause: [
        F.lit(source).alias("source"), at.cast("long").alias("at"), what.alias("description"), priority.alias("priority"), context.alias("context"), cause.alias("suspected_cause"),
    ]
    late = (open_failures(events) if late is None else late).filter(~is_interrupt()).withColumn("line", X.truncate(F.col("error"), 200))
    label = F.when(is_test(), LABEL["issue_test"]).otherwise(LABEL["issue_command"])
    blind = F.concat(label, F.col("action"), F.coalesce(X.filled(LABEL["issue_no_error"], F.col("exit_code")), F.lit("")))
    said = F.when(F.col("line") != "", F.concat(label, F.col("line"))).otherwise(blind)
    command = F.nullif(X.truncate(F.col("command"), 200), F.lit(""))
    tail = late.select(SESSION, *issue(1, F.col("seq"), said, F.when(is_test(), "high").otherwise("medium"), command, F.lit(LABEL["cause_open"])))
    stops = events.filter(is_interrupt()).select(SESSION, *issue(2, F.col("seq"), F.lit(LABEL["issue_interrupted"]), F.lit("medium"), F.nullif("reason", F.lit("")), text))
    gone = project.filter("not exists and coalesce(cwd, '') != ''").select(
        SESSION, *issue(3, F.lit(0), F.concat(F.lit(LABEL["issue_no_path"]), "cwd"), F.lit("high"), F.col("cwd"), F.lit(LABEL["cause_no_path"]))
    )
    bare = project.filter("exists and not is_git").select(SESSION, *issue(3, F.lit(0), F.lit(LABEL["issue_no_git"]), F.lit("low"), F.col("cwd"), text))
    again = repeated_errors(events).withColumn("rank", F.row_number().over(W.partitionBy(SESSION).orderBy("first_seq"))).filter("rank <= 2")
    errors = again.select(SESSION, *issue(4, F.col("first_seq"), F.concat(X.filled(LABEL["issue_repeated"], F.col("n")), "error"), F.lit("high"), text, F.lit(LABEL["cause_repeated"])))
    every = united(tail, stops, gone, bare, errors).withColumn("key", X.dedupe_key(F.col("description"), 40))
    return first_seen(every, "key", ["source", "at"], CAPS["issues"]).select(SESSION, "nth", "description", "priority", "context", "suspected_cause")


def next_actions(events: DataFrame, late: DataFrame | None = None) -> DataFrame:
    """session_id, nth, action, reason: open failures, else the steps that the last reply lists, else a default one."""
    late = (open_failures(events) if late is None else late).filter(~is_interrupt()).filter("coalesce(command, '') != '' or size(paths) > 0")
    line = X.truncate(F.col("error"), 160)
    said = F.concat(F.lit(LABEL["action_fix"]), "action", F.when(line != "", X.filled(LABEL["action_error"], line)).otherwise(""))
    fixes = late.select(SESSION, "seq", said.alias("said"), X.dedupe_key(F.col("action"), 40).alias("key"))
    steps = first_seen(fixes, "key", ["seq"], CAPS["actions"]).select(SESSION, "nth", F.col("said").alias("action"), F.lit(LABEL["reason_fix"]).alias("reason"))
    rest = events.select(SESSION).distinct().join(steps.select(SESSION).distinct(), SESSION, "left_anti")
    last = events.filter("type = 'assistant_message'").groupBy(SESSION).agg(F.max_by("content", "seq").alias("content")).join(rest, SESSION)
    items = last.select(SESSION, F.posexplode(F.regexp_extract_all("content", F.lit(LIST_ITEM), F.lit(1))).alias("seq", "item")).withColumn("item", X.collapse(F.col("item")))
    items = items.filter((F.length("item") >= 8) & (F.rlike("item", F.lit(ACTION_LEAD)) | F.rlike("item", F.lit(PENDING)))).withColumn("key", X.dedupe_key(F.col("item"), 40))
    listed = first_seen(items, "key", ["seq"], CAPS["actions"]).select(SESSION, "nth", X.truncate(F.col("item"), 200).alias("action"), F.lit(LABEL["reason_listed"]).alias("reason"))
    left = rest.join(listed.select(SESSION).distinct(), SESSION, "left_anti")
    default = left.select(SESSION, F.lit(1).cast("long").alias("nth"), F.lit(LABEL["action_default"]).alias("action"), F.lit(LABEL["reason_default"]).alias("reason"))
    return united(steps, listed, default)


def without_completed(actions: DataFrame, done: DataFrame, n: int = 16) -> DataFrame:
    """Actions whose first n characters don't occur in what the session has completed.  done: implementation()."""
    blob = done.select(SESSION, F.lower(F.array_join("completed", " ")).alias("blob"))
    probe = F.left(F.lower(X.strip(F.col("action"))), F.lit(n))
    return actions.join(blob, SESSION, "left").filter(~F.coalesce((probe != "") & F.contains("blob", probe), F.lit(False))).drop("blob")


def risks(events: DataFrame, project: DataFrame, n_secrets: DataFrame | None = None) -> DataFrame:
    """session_id, risks: array of struct(description, impact, mitigation).  n_secrets has session_id and n."""
    again = repeated_errors(events).select(SESSION).distinct().withColumn("again", F.lit(True))
    rows = events.select(SESSION).distinct().join(again, SESSION, "left").join(project.select(SESSION, "exists", "is_git", "n_changed"), SESSION, "left")
    rows = rows.join(n_secrets.select(SESSION, F.col("n").alias("secrets")), SESSION, "left") if n_secrets is not None else rows.withColumn("secrets", F.lit(0))

    def risk(name: str, when: Column, *values: Column) -> Column:
        what, impact, remedy = RISKS[name]
        return F.when(when, F.struct(X.filled(what, *values).alias("description"), F.lit(impact).alias("impact"), F.lit(remedy).alias("mitigation")))

    changed, secrets = F.coalesce("n_changed", F.lit(0)), F.coalesce("secrets", F.lit(0))
    found = F.array_compact(
        F.array(
            risk("repeated", F.coalesce("again", F.lit(False))),
            risk("uncommitted", F.coalesce("is_git", F.lit(False)) & (changed > 0), changed),
            risk("secrets", secrets > 0, secrets),
            risk("no_path", ~F.coalesce("exists", F.lit(False))),
        )
    )
    return rows.select(SESSION, F.slice(found, 1, CAPS["risks"]).alias("risks"))


def task(events: DataFrame, sessions: DataFrame, project: DataFrame, totals: DataFrame | None = None, late: DataFrame | None = None) -> DataFrame:
    """session_id, title, goal, background, requirements, constraints, status, confidence.  sessions: session_id, agent, cwd, model."""
    asked = requirements(events).groupBy(SESSION).agg(A.listed("line", "nth").alias("requirements"))
    totals = counts(events) if totals is None else totals
    rows = totals.join(goals(events), SESSION).join(status(events, totals, late), SESSION).join(asked, SESSION, "left")
    rows = rows.join(sessions.select(SESSION, "agent", "cwd", "model"), SESSION, "left").join(project.select(SESSION, "exists", "constraints"), SESSION, "left")
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", X.filled(LABEL[name], F.col(c)))
    background = F.concat_ws(
        "；", part("from_agent", "agent"), part("in_folder", "cwd"), part("with_model", "model"), X.filled(LABEL["counts"], *[F.col(c) for c in ("user_messages", "tool_calls", "failures")]),
        F.when(~F.coalesce("exists", F.lit(False)), LABEL["path_gone"]),
    )
    none = F.array().cast("array<string>")
    return rows.select(
        SESSION, F.concat(F.lit("task_"), F.col(SESSION).cast("string")).alias("id"), "title", "goal", background.alias("background"), F.coalesce("requirements", none).alias("requirements"),
        F.slice(F.coalesce("constraints", none), 1, CAPS["constraints"]).alias("constraints"), "status", "confidence", F.lit("heuristic").alias("reconstructed_by"),
    )


def stats(events: DataFrame, bundles: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """session_id, stats: the counters of the session and of its compression (bundles: compress.bundles)."""
    names = ["total_events", "user_messages", "tool_calls", "failures", "test_runs", "edited_files"]
    rows = (counts(events) if totals is None else totals).join(bundles.select(SESSION, "estimated_tokens", "stats"), SESSION, "left")
    return rows.select(SESSION, F.struct(F.lit("heuristic").alias("reconstruction"), *names, F.col("estimated_tokens").alias("digest_tokens_estimate"), F.col("stats").alias("compression")).alias("stats"))


#: What a project table may say of a session's project and its version control; what it doesn't is empty.
PROJECT = {
    "name": "string", "cwd": "string", "languages": "array<string>", "frameworks": "array<string>", "structure_summary": "string", "modules": "array<string>",
    "branch": "string", "commit": "string", "status_summary": "string", "changed_files": "array<string>", "diff_summary": "string", "n_changed": "int", "system": "string", "shell": "string",
}


def facts(sessions: DataFrame, project: DataFrame, commands: DataFrame) -> DataFrame:
    """session_id, metadata, project, git, runtime: where a document comes from and what its project is like, as found there.

    commands: session_id and recent_commands.  Changed files are sorted; there are uncommitted changes if any is listed or counted.
    """
    none = F.array().cast("array<string>")
    given = lambda c: F.col(c).cast(PROJECT[c]) if c in project.columns else F.lit(None).cast(PROJECT[c])
    rows = project.select(SESSION, *[given(c).alias(c) for c in PROJECT], (F.col("constraints") if "constraints" in project.columns else none).alias("limits"))
    rows = sessions.select(SESSION, "agent").join(rows, SESSION, "left").join(commands, SESSION, "left")
    each = lambda c: F.coalesce(F.col(c), none)
    text = lambda c: F.coalesce(c, F.lit(""))
    return rows.select(
        SESSION,
        F.struct(F.col("agent").alias("source_agent"), F.col(SESSION).cast("string").alias("source_session_id"), F.lit("1.0").alias("schema_version")).alias("metadata"),
        F.struct(text("name").alias("name"), text("cwd").alias("path"), each("languages").alias("language"), each("frameworks").alias("framework"), "structure_summary", each("modules").alias("important_modules"), each("limits").alias("project_constraints")).alias("project"),
        F.struct("branch", "commit", "status_summary", F.array_sort(each("changed_files")).alias("changed_files"), "diff_summary", ((F.coalesce("n_changed", F.lit(0)) > 0) | (F.size(each("changed_files")) > 0)).alias("has_uncommitted_changes")).alias("git"),
        F.struct(text("cwd").alias("working_directory"), text("system").alias("operating_system"), "shell", each("recent_commands").alias("recent_commands")).alias("runtime"),
    )


def reconstruct(
    events: DataFrame, sessions: DataFrame, project: DataFrame, n_secrets: DataFrame | None = None, max_tokens: int | None = 12_000,
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> DataFrame:
    """One document per session: its sections as structs and arrays.  max_tokens is a document's budget; without one, digests aren't compressed but for UNCOMPRESSED tokens.

    keep(table, name) is called with what several sections read; one that writes it has it computed once.
    """
    totals, failed = keep(counts(events), "counts"), keep(failures(events), "failures")
    late = keep(open_failures(events, failed), "open")
    bundles = keep(compress.bundles(events, UNCOMPRESSED if max_tokens is None else DIGEST_TIMES * max_tokens), "bundles")
    done = keep(implementation(events, totals), "done")
    todo = without_completed(next_actions(events, late), done)
    array = lambda rows, fields, name: rows.groupBy(SESSION).agg(A.listed(F.struct(*fields), "nth").alias(name))
    whole = lambda rows, name: rows.select(SESSION, F.struct(*[c for c in rows.columns if c != SESSION]).alias(name))
    commands = A.recent_commands(events.filter(F.col("category").isin("terminal", "build", "test")), 20, 200).withColumnRenamed("commands", "recent_commands")
    sections = {
        "task": whole(task(events, sessions, project, totals, late), "task"),
        "conversation": whole(conversation(events, sessions, bundles.filter("truncated"), totals), "conversation"),
        "implementation": whole(done, "implementation"),
        "decisions": array(decisions(events), ["decision", F.lit(LABEL["reason_decision"]).alias("reason"), "ts"], "decisions"),
        "attempts": array(attempts(events, failed), ["action", "result", "success", "error", "lesson"], "attempts"),
        "validation": whole(validation(events), "validation"),
        "unresolved": array(unresolved(events, project, late), ["description", "priority", "context", "suspected_cause"], "unresolved"),
        "next_actions": array(todo, ["action", "reason", F.col("nth").alias("priority"), F.lit(False).alias("completed")], "next_actions"),
        "risks": risks(events, project, n_secrets),
        "facts": facts(sessions, project, commands),
        "stats": stats(events, bundles, totals),
    }
    out = totals.select(SESSION)
    for name, section in sections.items():
        out = out.join(keep(section, name), SESSION, "left")
    return out
