"""What the newest few logs say, without reading the others: listings from headers, lookup by content, evidence of failed calls.

Files are ranked by what their folder says of them; only those that are wanted are opened, and of those no more than a
header where that is enough.  `k` bounds the paths that reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import AUTH_FAILED, REFUSED
from ..functions import text as X
from ..functions import variants as V
from .json_log import find_session, newest_first, read_json_log, records_by_session
from .rollout import rollout_events, rollout_sessions

#: Bytes of a file's start that a listing and a lookup read.
LISTED_BYTES = 262_144
LOOKUP_BYTES = 32_768


def newest(files: DataFrame, k: int) -> list[str]:
    """The paths of the k files changed last, of files(path, modified)."""
    return [r["path"] for r in newest_first(files.select("path", "modified"), k).collect()]


def session_listing(
    spark: SparkSession, files: DataFrame, k: int = 20, deep: bool = False,
    sessions: Callable[[DataFrame], DataFrame] = rollout_sessions, events: Callable[[DataFrame], DataFrame] = rollout_events,
) -> DataFrame:
    """The k sessions changed last: path, session_id, modified, size, archived, cwd, model, created_at, title, n_records, n_user.

    Without `deep` only the first LISTED_BYTES of each of the k files are read, and the numbers of records and of user
    messages are null, for they aren't known.  A session is named by what its records say, else after its file.
    """
    paths = newest(files, k)
    chosen = files.filter(F.col("path").isin(paths))
    records = records_by_session(read_json_log(spark, paths, None if deep else LISTED_BYTES, pattern="*"), chosen)
    said = events(records).filter("type = 'user_message'").groupBy("session_id").agg(F.min_by("content", "seq").alias("first"), F.count(F.lit(1)).alias("n_user"))
    counted = records.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_records"))
    rows = chosen.join(sessions(records), "session_id", "left").join(said, "session_id", "left").join(counted, "session_id", "left")
    known = lambda c: F.when(F.lit(deep), F.coalesce(c, F.lit(0))).alias(c)
    return newest_first(
        rows.select("path", F.coalesce("stated_id", "session_id").alias("session_id"), "modified", "size", "archived", "cwd", "model", "created_at", X.title_of(F.col("first")).alias("title"), known("n_records"), known("n_user"))
    )


def found_session(spark: SparkSession, files: DataFrame, wanted: str) -> DataFrame:
    """The file of a session: that named so, else the first whose name contains it, else the first whose header says it.

    The headers, LOOKUP_BYTES of each file, are read only where no name tells.  A blank id is no session's.
    """
    needle = wanted.strip()
    if not needle:
        return files.limit(0)
    named = find_session(files, needle)
    if not named.isEmpty():
        return named
    v, kind = F.try_parse_json("record"), F.col("v")
    heads = read_json_log(spark, [r["path"] for r in _roots(files)], LOOKUP_BYTES, pattern="*").select("path", v.alias("v"))
    told = [V.string(kind, f"$.payload.{n}") == needle for n in ("session_id", "id")]
    hits = heads.filter((V.string(kind, "$.type") == "session_meta") & (F.coalesce(told[0], F.lit(False)) | F.coalesce(told[1], F.lit(False)))).select("path").distinct()
    return files.join(hits, "path", "left_semi").orderBy("path").limit(1)


def _roots(files: DataFrame):
    """The folders that files lie in: fewer than the files, and all that the driver has to name."""
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().collect()


def failed_logins(spark: SparkSession, files: DataFrame, k: int = 5) -> DataFrame:
    """One row: checked, the number of files looked at (the k changed last), failures, how many of them tell of a failed login, and all_failed."""
    paths = newest(files, k)
    rows = spark.read.text(paths, wholetext=True) if paths else spark.createDataFrame([], "value string")
    hit = F.count_if(F.rlike("value", F.lit(AUTH_FAILED)))
    return rows.agg(F.count(F.lit(1)).alias("checked"), hit.alias("failures")).withColumn("all_failed", (F.col("checked") > 0) & (F.col("checked") == F.col("failures")))


def last_reply(spark: SparkSession, files: DataFrame) -> DataFrame:
    """path and state of the last reply in the newest file: fine, or refused for its login, its quota or another reason; none without a reply."""
    paths = newest(files, 1)
    v = F.col("v")
    records = read_json_log(spark, paths, pattern="*").select("path", "seq", F.try_parse_json("record").alias("v"))
    last = records.filter(V.string(v, "$.type") == "assistant").groupBy("path").agg(F.max_by("v", "seq").alias("v"))
    message = F.lower(F.coalesce(F.to_json(V.at(v, "$.message")), F.lit("")))
    has = lambda words: F.rlike(message, F.lit("|".join(words)))
    state = F.when(~V.truthy(v, "$.isApiErrorMessage"), "fine").when(has(REFUSED["login"]), "login").when(has(REFUSED["quota"]), "quota").otherwise("refused")
    newest_file = files.filter(F.col("path").isin(paths)) if paths else files.limit(0)
    return newest_file.select("path").join(last.select("path", state.alias("state")), "path", "left").select("path", F.coalesce("state", F.lit("none")).alias("state"))


