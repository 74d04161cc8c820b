"""Aggregates per session.  Each combines rows before the shuffle wherever the result allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.tables import united

SESSION = "session_id"


def listed(what: Column | str, by: Column | str = "seq") -> Column:
    """The values in the order of `by`, as an aggregate."""
    value = F.col(what) if isinstance(what, str) else what
    key = F.col(by) if isinstance(by, str) else by
    return F.transform(F.array_sort(F.collect_list(F.struct(key.alias("by"), value.alias("value")))), lambda s: s["value"])


def dedup_messages(messages: DataFrame, keys: list[str], content: str = "content", longer_than: int = 40) -> DataFrame:
    """Messages without the repeats of long ones: the first by seq of equal stripped texts stays.  Keys, not texts, are shuffled."""
    t = X.strip(F.col(content))
    marked = messages.withColumn("_long", F.length(t) > longer_than).withColumn("_hash", F.sha2(t, 256))
    first = marked.filter("_long").groupBy(*keys, "_hash").agg(F.min("seq").alias("seq"))
    same = F.lit(True)
    for c in [*keys, "_hash", "seq"]:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kept = marked.filter("_long").alias("a").join(first.alias("b"), same, "left_semi")
    return united(marked.filter("not _long"), kept.select(*marked.columns)).drop("_long", "_hash")


def session_rollup(events: DataFrame) -> DataFrame:
    """Counts of what a session holds, and how far they can be trusted."""
    n = lambda condition: F.count_if(F.expr(condition))
    counts = events.groupBy(SESSION).agg(
        n("type = 'user_message'").alias("n_user"),
        n("type = 'assistant_message'").alias("n_assistant"),
        n("type = 'tool_call'").alias("n_tools"),
        n("is_failure").alias("n_failures"),
    )
    signals = F.col("n_user") + F.col("n_assistant") + F.col("n_tools")
    level = F.when(signals == 0, "unknown").when(F.col("n_user") == 0, "low").when(signals < 8, "low").otherwise("medium")
    return counts.withColumn("confidence", level)


def read_paths(events: DataFrame) -> DataFrame:
    """Distinct paths of reads in the order they were first seen."""
    first = events.filter("category = 'file_read'").groupBy(SESSION, "path").agg(F.min("seq").alias("seq"))
    return first.groupBy(SESSION).agg(listed("path").alias("paths"))


def edited_files(events: DataFrame) -> DataFrame:
    return (
        events.filter("category = 'file_edit'")
        .groupBy(SESSION, "path")
        .agg(
            F.count(F.lit(1)).alias("edits"),
            F.sum("added").alias("added"),
            F.sum("removed").alias("removed"),
            F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
            F.min("seq").alias("first_seq"),
        )
    )


def repeated_errors(events: DataFrame, least: int = 3, shortest: int = 12) -> DataFrame:
    named = events.filter("is_failure").filter(F.length("error") >= shortest)
    return named.groupBy(SESSION, "error").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq")).filter(F.col("n") >= least)


def attempts(events: DataFrame, most: int = 15) -> DataFrame:
    """Distinct failed actions, first-seen order, the first `most`; repeats after the last of these has been seen don't count."""
    failed = events.filter("is_failure").withColumn("key", X.dedupe_key(F.col("command"), 80))
    firsts = failed.groupBy(SESSION, "key").agg(F.min("seq").alias("first_seq"))
    ranked = firsts.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy("first_seq"))).filter(F.col("nth") <= most)
    cut = ranked.groupBy(SESSION).agg(F.max(F.when(F.col("nth") == most, F.col("first_seq"))).alias("cut"))
    counted = failed.join(cut, SESSION).filter(F.col("cut").isNull() | (F.col("seq") <= F.col("cut"))).groupBy(SESSION, "key").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(counted, [SESSION, "key"]).select(SESSION, "key", "nth", "first_seq", "n")


def last_per_command(events: DataFrame) -> DataFrame:
    """The last run of each test or build command."""
    runs = events.filter("category in ('test', 'build')")
    last = F.max_by(F.struct("category", "is_failure", "exit_code"), "seq").alias("r")
    return runs.groupBy(SESSION, F.trim("command").alias("command")).agg(F.max("seq").alias("seq"), last).select(SESSION, "command", "seq", "r.*")


def last_build(events: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("seq", "command", "is_failure"), "seq").alias("r")
    return events.filter("category = 'build'").groupBy(SESSION).agg(last).select(SESSION, "r.*")


def recent_commands(events: DataFrame, most: int = 20, limit: int = 60) -> DataFrame:
    """Distinct commands by their first use, the last `most` of them."""
    firsts = events.groupBy(SESSION, X.truncate(F.col("command"), limit).alias("command")).agg(F.min("seq").alias("seq"))
    late = firsts.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy(F.desc("seq")))).filter(F.col("nth") <= most)
    return late.groupBy(SESSION).agg(listed("command").alias("commands"))


def ends(messages: DataFrame, role: str, k: int, last: bool, what: str = "content") -> DataFrame:
    """The first or last k rows of a role, with nth from 1 in order."""
    own = messages.filter(F.col("role") == role)
    order = F.desc("seq") if last else F.col("seq")
    cut = own.withColumn("r", F.row_number().over(W.partitionBy(SESSION).orderBy(order))).filter(F.col("r") <= k).drop("r")
    return cut.withColumn("nth", F.row_number().over(W.partitionBy(SESSION).orderBy("seq"))).select(SESSION, "nth", "seq", what)


def backwards(events: DataFrame) -> DataFrame:
    """events with `back`, their number from the end of the session."""
    return events.withColumn("back", F.row_number().over(W.partitionBy(SESSION).orderBy(F.desc("seq"))))


def tail_failures(events: DataFrame, tail: int = 15) -> DataFrame:
    """The failures among the last events of each session.  The rank's limit is applied before the shuffle."""
    return backwards(events).filter(F.col("back") <= tail).filter("is_failure")
