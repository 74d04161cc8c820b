"""Events of any format as normalised rows: one per action, with a category, a summary, an outcome and a significance.

Results are merged into the rows of their calls, so an action is one row; the join is on session and call, which no two
calls share, so nothing is skewed by a busy session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import LABEL
from ..functions import text as X
from ..functions.tables import united
from . import classify
from .aggregate import dedup_messages

#: Category to event type; the others stay tool calls.
TYPES = {c: c for c in ("terminal", "file_edit", "file_read", "plan", "tool_call", "tool_result")} | {"test": "test", "build": "test"}
COLUMNS = [
    "agent", "session_id", "seq", "event_id", "ts", "type", "category", "role", "summary", "content", "tool_name", "paths", "files", "command", "result",
    "is_failure", "exit_code", "significance", "kind", "reason", "injected_prompt", "result_attached", "nonzero_is_normal",
]


def edit_summary(paths: Column, files: Column) -> Column:
    """What an edit changed, path by path: its hunks and lines where the patch tells, else its status."""

    def one(path: Column) -> Column:
        f = F.get(F.filter(files, lambda x: x["path"] == path), F.lit(0))
        counts = X.filled("（{} 处，+{}/-{}）", f["hunks"], f["added"], f["removed"])
        return F.concat(path, F.coalesce(counts, X.filled("（{}）", F.coalesce(f["status"], F.lit("modified")))))

    return F.when(F.size(paths) > 0, F.concat(F.lit(LABEL["edit"]), F.array_join(F.transform(paths, one), "；"))).otherwise(LABEL["edit_unknown"])


def call_summary(category: Column) -> Column:
    command, tool, paths = F.col("command"), F.col("tool_name"), F.col("paths")
    read = F.concat(F.lit(LABEL["read"]), F.array_join(F.slice(paths, 1, 6), "、"))
    search = F.concat(F.lit(LABEL["search"]), X.truncate(F.coalesce(F.nullif(command, F.lit("")), tool), 120))
    return (
        F.when(category == "terminal", F.concat(F.lit(LABEL["command"]), X.truncate(command, 160)))
        .when(category == "build", F.concat(F.lit(LABEL["build"]), X.truncate(command, 160)))
        .when(category == "file_edit", edit_summary(paths, F.col("files")))
        .when(category == "file_read", F.when(F.size(paths) > 0, read).otherwise(search))
        .when(category == "plan", LABEL["plan"])
        .otherwise(F.concat(F.lit(LABEL["tool"]), F.coalesce(F.nullif(tool, F.lit("")), F.lit("unknown"))))
    )


def merged_results(events: DataFrame) -> DataFrame:
    """Per call that has results: the last output, exit code and outcome, and whether an expected exit code came after the last failure."""
    results = events.filter("type = 'tool_result' and call_seq is not null")
    expected = F.col("is_failure") & classify.expected_nonzero(F.col("command"), F.col("exit_code"))
    hard = F.col("is_failure") & ~expected
    at = lambda condition: F.max(F.when(condition, F.col("seq")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return results.groupBy("session_id", F.col("call_seq").alias("seq")).agg(
        F.max_by(X.strip_ansi(F.coalesce("result", "content")), "seq").alias("r_result"),
        last("exit_code").alias("r_code"),
        last("is_failure").alias("r_failed"),
        at(hard).alias("r_hard"),
        at(expected).alias("r_expected"),
    )


def normalise(events: DataFrame) -> DataFrame:
    """events of the formats, with call_seq, as rows of COLUMNS."""
    calls = events.filter("type = 'tool_call'").join(merged_results(events), ["session_id", "seq"], "left")
    has = F.col("r_result").isNotNull()
    calls = calls.withColumns(
        {
            "paths": F.coalesce("paths", F.array().cast("array<string>")),
            "category": classify.call_category(F.col("tool_name"), F.col("command"), F.col("category_hint")),
            "exit_code": F.coalesce("r_code", "exit_code"),
            "failed": F.coalesce("r_failed", "is_failure", F.lit(False)),
        }
    )
    normal = has & F.col("failed") & classify.expected_nonzero(F.col("command"), F.col("exit_code"))
    calls = calls.withColumns({"nonzero_is_normal": normal, "is_failure": F.col("failed") & ~normal, "result_attached": has})
    raised = F.coalesce(F.col("r_hard") > F.coalesce("r_expected", F.lit(-1)), F.lit(False))
    calls = calls.withColumn(
        "significance",
        F.when(has & F.col("is_failure"), F.greatest("significance", F.lit(3))).when(normal, 1).when(raised, 3).when(F.col("r_expected").isNotNull(), 1).otherwise(F.col("significance")),
    )
    is_test = F.col("category").isin("test", "build")
    said = F.concat(
        F.when(F.col("category") == "build", LABEL["build_word"]).otherwise(LABEL["test_word"]),
        F.when(F.col("is_failure"), LABEL["failed_word"]).otherwise(LABEL["passed_word"]),
        F.lit("："),
        X.truncate(F.col("command"), 140),
    )
    types = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    calls = calls.withColumns(
        {
            "summary": F.when(is_test, said).otherwise(call_summary(F.col("category"))),
            "type": F.coalesce(F.try_element_at(types, F.col("category")), F.lit("tool_call")),
            "content": X.strip_ansi(F.col("content")),
            "result": F.coalesce("r_result", X.strip_ansi(F.col("result"))),
            "injected_prompt": F.lit(False),
        }
    )

    kind = F.col("type")
    rest = events.filter("type != 'tool_call' and not (type = 'tool_result' and call_seq is not null)")
    rest = rest.withColumns({"inner": F.when(kind == "user_message", X.unwrapped_prompt(F.col("content"))), "failed": F.coalesce("is_failure", F.lit(False))})
    message = kind.isin("user_message", "assistant_message", "reasoning")
    rest = rest.withColumns(
        {
            "category": F.when(kind == "session_meta", "meta").when(message | kind.isin("error", "tool_result"), kind).otherwise(F.coalesce("category_hint", F.lit("tool_call"))),
            "summary": F.when(kind.isin("session_meta", "error"), X.collapse(F.col("content")))
            .when(kind == "tool_result", LABEL["orphan"])
            .otherwise(X.first_line(F.coalesce("inner", "content"), 160)),
            "content": F.coalesce("inner", X.strip_ansi(F.col("content"))),
            "result": X.strip_ansi(F.col("result")),
            "paths": F.coalesce("paths", F.array().cast("array<string>")),
            "is_failure": F.when(kind == "error", True).otherwise(F.col("failed")),
            "significance": F.when(kind == "user_message", 3)
            .when(kind == "assistant_message", 2)
            .when(kind == "reasoning", 1)
            .when(kind == "error", F.greatest(F.coalesce("significance", F.lit(1)), F.lit(2)))
            .otherwise(F.coalesce("significance", F.lit(1))),
            "injected_prompt": F.col("inner").isNotNull(),
            "result_attached": F.lit(False),
            "nonzero_is_normal": F.lit(False),
        }
    )
    messages = dedup_messages(rest.filter("type in ('user_message', 'assistant_message')").select(*COLUMNS), ["session_id", "type", "role"])
    others = rest.filter("type not in ('user_message', 'assistant_message')").select(*COLUMNS)
    return united(calls.select(*COLUMNS), messages, others)
