"""The bubble-kv format: SQLite databases with a table of headers and one of keys and JSON values.

A database is read as a file, so it may lie wherever Spark reads from; its rows leave the task as they are found and
headers, data and bubbles meet in joins on the id that the keys contain.
"""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import variants as V
from .events import counted, event, first_of, last_of, numbered, with_calls

AGENT = "cursor"
DRAFT = "empty-state-draft"
ROWS = "path string, kind string, composer_id string, key string, value string, workspace_id string, created long, updated long, archived boolean, subagent boolean"
EDITS = ["assistantSuggestedDiffs", "diffsSinceLastApply", "humanChanges"]


def rows_of(data: bytes) -> Iterator[tuple]:
    """The headers and the keyed values of a database: kind, composer_id, key, value, then the header's other fields."""
    if data[18:20] == b"\x02\x02":  # a database in memory has no write-ahead log
        data = data[:18] + b"\x01\x01" + data[20:]
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(data)
        con.text_factory = lambda b: b.decode("utf-8", "replace")
        sql = "SELECT composerId, workspaceId, createdAt, lastUpdatedAt, isArchived, isSubagent FROM composerHeaders"
        for id_, space, created, updated, archived, subagent in con.execute(sql):
            if id_ and id_ != DRAFT:
                yield "header", id_, None, None, space, created, updated, bool(archived), bool(subagent)
        for key, value in con.execute("SELECT key, value FROM cursorDiskKV WHERE key LIKE 'composerData:%' OR key LIKE 'bubbleId:%'"):
            text = value.decode("utf-8", "replace") if isinstance(value, bytes) else value
            kind, _, rest = key.partition(":")
            yield ("data" if kind == "composerData" else "bubble"), rest.partition(":")[0], key, text, None, None, None, None, None
    finally:
        con.close()


def read_databases(spark: SparkSession, path: str, pattern: str = "*.vscdb") -> DataFrame:
    """The ROWS of all databases below a path; one that can't be read gives a row of kind `error`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                held: list[tuple] = []
                try:
                    for row in rows_of(bytes(data)):
                        held.append((file, *row))
                        if len(held) == 1000:
                            yield _frame(held, names)
                            held = []
                except sqlite3.Error as e:
                    held.append((file, "error", None, None, str(e), None, None, None, None, None))
                if held:
                    yield _frame(held, names)

    return files.select("path", "content").mapInPandas(run, ROWS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"created": "Int64", "updated": "Int64", "archived": "boolean", "subagent": "boolean"})


#: A token of JSON and the white space before it: a string, a bracket or mark, a number, a word.
TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|([][{}:,])|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null|NaN|-?Infinity))')


def tree_text(text: str) -> str:
    """The text nodes of a document tree, given as JSON, in order, with a line end behind each paragraph that has any.

    A node is an object, its children are the objects of its list `content`; of a key that occurs again the last one
    counts.  One pass over the tokens with a stack of its own, so a tree may be as deep as its text.  What is no JSON has no text.
    """
    out: list[str] = []  # the text so far; a node that turns out to be no child takes its own back
    # per open bracket: kind, key that is being read, where its text starts, where its content's does, own type and text
    stack: list[list] = []
    at, want = 0, "value"
    while True:
        found = TOKEN.match(text, at)
        if not found:
            break
        at = found.end()
        quoted, mark, number, word = found.groups()
        top = stack[-1] if stack else None
        if want == "end" or (mark == ":") != (want == ":"):
            return ""
        if want == ":":
            want = "value"
            continue
        if want in ("key", "key or }") and mark != "}":
            if quoted is None:
                return ""
            top[1], want = json.loads(quoted), ":"
            if top[1] == "content":
                del out[top[3] :]
                top[3] = len(out)
            continue
        if mark == "," and want == "comma":
            want = "key" if top[0] == "{" else "value"
            continue
        if mark in ("}", "]"):
            if top is None or mark != {"{": "}", "[": "]"}[top[0]] or want not in ("comma", "key or }" if mark == "}" else "value or ]"):
                return ""
            stack.pop()
            if mark == "}":
                _close(out, top, stack)
        elif want in ("comma", "key or }"):
            return ""
        elif mark in ("{", "["):
            stack.append([mark, None, len(out), len(out), None, None])
            want = "key or }" if mark == "{" else "value or ]"
            continue
        elif mark:
            return ""
        elif top and top[0] == "{" and top[1] in ("type", "text"):
            top[4 if top[1] == "type" else 5] = json.loads(quoted) if quoted is not None else None
        if mark and stack and stack[-1][0] == "{" and stack[-1][1] in ("type", "text"):
            stack[-1][4 if stack[-1][1] == "type" else 5] = None
        want = "comma" if stack else "end"
    return "".join(out) if want == "end" and not text[at:].strip(" \t\n\r") else ""


def _close(out: list[str], node: list, stack: list[list]) -> None:
    """A node ends: its own text goes before its children's; a node that isn't a child of `content` takes all of it back."""
    _, _, first, _, kind, own = node
    listed = len(stack) > 1 and stack[-1][0] == "[" and stack[-2][0] == "{" and stack[-2][1] == "content"
    if stack and not listed:
        del out[first:]
        return
    if kind == "text" and own:
        out.insert(first, own)
    if kind == "paragraph" and len(out) > first:
        out.append("\n")


def prose(tree: Column) -> Column:
    """The text of a document tree given as JSON; trees are of any depth, so this runs in Python."""

    def run(trees: pd.Series) -> pd.Series:
        return trees.map(lambda t: tree_text(t) if t else "")

    return F.pandas_udf(run, "string")(tree)


def bubble_text(b: Column) -> Column:
    """A bubble's text, else its rich text: a plain string, or a tree as JSON or as an object."""
    rich = X.strip(V.string(b, "$.richText"))
    tree = F.when(V.is_object(V.at(b, "$.richText")), F.to_json(V.at(b, "$.richText"))).when(F.startswith(rich, F.lit("{")), rich)
    plain = F.nullif(X.strip(V.string(b, "$.text")), F.lit(""))
    return F.coalesce(plain, F.when(tree.isNotNull(), prose(tree)), rich, F.lit(""))


def thinking_text(b: Column) -> Column:
    bare = lambda c: F.nullif(X.strip(c), F.lit(""))
    blocks = F.transform(V.items(b, "$.allThinkingBlocks"), lambda t: bare(F.coalesce(V.filled(t, "$.text"), V.string(t, "$.thinking"))))
    return F.coalesce(bare(V.string(b, "$.thinking.text")), bare(V.string(b, "$.thinking")), F.array_join(F.filter(blocks, lambda t: t.isNotNull()), "\n\n"))


def sessions(rows: DataFrame) -> DataFrame:
    """The headers that have bubbles, with the bubbles' number, how many the user wrote and their size, newest first by `updated`."""
    v = F.try_parse_json("value")
    bubbles = rows.filter("kind = 'bubble'").withColumn("v", v).filter(V.is_object(F.col("v")))
    sizes = bubbles.groupBy("path", "composer_id").agg(
        F.count(F.lit(1)).alias("n_bubbles"), F.count_if(V.at(F.col("v"), "$.type", "int") == 1).alias("n_user"), F.sum(F.length("value")).cast("long").alias("size")
    )
    data = rows.filter("kind = 'data'").select("path", "composer_id", v.alias("v"))
    stated = data.select(
        "path", "composer_id", V.filled(F.col("v"), "$.name").alias("name"), V.string(F.col("v"), "$.status").alias("status"), V.filled(F.col("v"), "$.modelConfig.modelName").alias("model")
    )
    headers = rows.filter("kind = 'header'").select("path", "composer_id", "workspace_id", "created", "updated", "archived", "subagent")
    return headers.join(sizes, ["path", "composer_id"]).join(stated, ["path", "composer_id"], "left").orderBy(F.desc_nulls_last("updated"), "path", "composer_id")


def bubbles_in_order(rows: DataFrame) -> DataFrame:
    """The bubbles of known headers: session_id, seq (by the text of their time), v."""
    known = rows.filter("kind = 'header'").select("path", "composer_id")
    v = F.col("v")
    read = rows.filter("kind = 'bubble'").select("path", "composer_id", "key", F.try_parse_json("value").alias("v")).filter(V.is_object(v)).join(known, ["path", "composer_id"])
    stamp = F.coalesce(V.filled(v, "$.createdAt"), V.at(v, "$.createdAtMs", "string"), F.lit(""))
    nth = F.row_number().over(W.partitionBy("path", "composer_id").orderBy("stamp", "key"))
    return read.withColumn("stamp", stamp).select(F.col("composer_id").alias("session_id"), nth.cast("long").alias("seq"), "v")


def bubble_events(bubbles: DataFrame) -> DataFrame:
    """bubbles(session_id, seq, v) as events: of a reply its thinking, its text, its edits by kind and its tool results."""
    v, id_, text, thought, x = (F.col(c) for c in ("v", "id", "text", "thought", "x"))
    ms = F.coalesce(V.at(v, "$.createdAt", "double"), V.at(v, "$.createdAtMs", "double"))
    stamp = F.coalesce(X.iso_time(V.string(v, "$.createdAt")), F.when(ms > 1_000_000_000_000, X.epoch_time(ms)))
    own_id = F.coalesce(V.filled(v, "$.bubbleId"), (F.col("seq") - 1).cast("string"))
    rows = bubbles.select("session_id", "seq", "v", stamp.alias("ts"), own_id.alias("id"), bubble_text(v).alias("text"), thinking_text(v).alias("thought"), V.at(v, "$.type", "int").alias("by"))
    part = lambda what, value=None: F.struct(F.lit(what).alias("what"), (F.lit(None).cast("variant") if value is None else value).alias("x"))
    parts = F.concat(
        F.array(part("thinking"), part("text"), *[part(k, V.at(v, f"$.{k}")) for k in EDITS]), F.transform(V.items(v, "$.toolResults"), lambda r: part("result", r))
    )
    rows = rows.select("*", F.posexplode(F.when(F.col("by") == 2, parts).otherwise(F.array(part("text")))).alias("place", "q")).select("*", "q.*").drop("q")
    path = lambda d: F.when(V.is_object(V.at(d, "$.uri")), V.filled(d, "$.uri.path")).otherwise(
        F.coalesce(V.filled(d, "$.path"), V.filled(d, "$.filePath"), V.filled(d, "$.relativeWorkspacePath"))
    )
    rows = rows.withColumn("diffs", F.when(F.col("what").isin(EDITS), F.filter(V.items(x), V.is_object)))
    value = [F.when(V.truthy(x, f"$.{k}"), F.coalesce(V.string(x, f"$.{k}"), F.to_json(V.at(x, f"$.{k}")))) for k in ("result", "output", "content")]
    rows = rows.withColumns(
        {
            "paths": F.array_distinct(F.filter(F.transform("diffs", path), lambda p: p.isNotNull())),
            "lines": F.flatten(F.transform("diffs", lambda d: X.lines(F.coalesce(V.filled(d, "$.diff"), V.string(d, "$.text"))))),
            "cut": X.truncate(F.coalesce(*value, F.lit("")), 4000),
        }
    )
    count = lambda pattern: F.size(F.filter("lines", lambda t: F.rlike(t, F.lit(pattern))))
    rows = rows.withColumns({"hunks": count("^@@"), "added": count(r"^\+(?!\+\+)"), "removed": count("^-(?!--)")})
    named = lambda tail: F.concat(id_, F.lit(":"), tail)
    user = event(ordinal=id_, type="user_message", role="user", content=text, significance=3)
    reply = event(ordinal=id_, type="assistant_message", role="assistant", content=text, significance=2)
    thinking = event(ordinal=named(F.lit("thinking")), type="reasoning", role="assistant", content=thought, kind="thinking", significance=1)
    files = F.transform("paths", lambda p: F.struct(p.alias("path"), F.lit("modified").alias("status"), *[F.col(c).alias(c) for c in ("hunks", "added", "removed")]))
    edit = event(
        ordinal=named(F.col("what")), type="tool_call", role="assistant", content=X.truncate(F.to_json("x"), 3000), tool_name="cursor_apply_diff", kind="tool_call",
        paths=F.col("paths"), files=files, category_hint="file_edit", significance=2,
    )
    result = event(
        ordinal=named(F.concat(F.lit("tool"), (F.col("place") - 2 - len(EDITS)).cast("string"))), type="tool_result", role="tool", content=F.col("cut"), result=F.col("cut"),
        tool_name=F.coalesce(V.filled(x, "$.name"), V.filled(x, "$.toolName"), F.lit("cursor_tool")), kind="tool_output",
        is_failure=V.truthy(x, "$.isError") | V.truthy(x, "$.is_error"), significance=1,
    )
    what, by = F.col("what"), F.col("by")
    made = (
        F.when((by == 1) & (text != ""), user)
        .when((by == 2) & (what == "thinking") & (thought != ""), thinking)
        .when((by == 2) & (what == "text") & (text != ""), reply)
        .when((by == 2) & what.isin(EDITS) & (F.size("paths") > 0), edit)
        .when((by == 2) & (what == "result") & V.is_object(x), result)
    )
    return with_calls(numbered(rows.select("session_id", "seq", "place", "ts", made.alias("e")), AGENT))


def bubble_counters(bubbles: DataFrame) -> DataFrame:
    """Per session its bubbles, and how many of them give no event."""
    used = bubble_events(bubbles).select("session_id", F.floor(F.col("seq") / 1000).alias("seq")).distinct().withColumn("used", F.lit(True))
    return counted(bubbles.join(used, ["session_id", "seq"], "left").withColumn("skipped", F.when(F.col("used").isNull(), "bubble/empty")))


def bubble_models(bubbles: DataFrame) -> DataFrame:
    """Per session the first model that a bubble names."""
    return bubbles.groupBy("session_id").agg(first_of(V.filled(F.col("v"), "$.modelInfo.modelName")).alias("model"), last_of(F.col("seq")).alias("last_seq"))
