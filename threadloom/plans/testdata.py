"""The test tables as event tables: conversations as messages, events as a stream of tool calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COMMANDS = [
    "pytest -q tests/", "python3 -m unittest discover", "mvn -q test -pl", "./gradlew :app:test", "yarn test --watch", "go test ./...", "cargo test", "dotnet test",
    "cd web && npx jest", "mvn package -pl", "gradle assemble", "pnpm run build", "go build ./cmd", "tsc -p .", "vite build --mode x", "ruff check src/", "npm run lint",
    "golangci-lint run", "rg -n todo", "git diff --quiet", "which tool", "git diff", "mypytest latest", "cat notes",
]
CATEGORIES = ["terminal", "test", "build", "file_read", "file_edit"]
TOOLS = {"click": "shell", "view": "read", "purchase": "edit", "signup": "todo_write", "error": "browser"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, role, content, type of the turns that users and assistants wrote."""
    c = table(spark, sf_dir, "conversations").filter("role in ('user', 'assistant')")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"), F.concat("role", F.lit("_message")).alias("type"))


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns: conv_id, turn, role, text (never null)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: a user's events in order of time, with a command, category, path and outcome made from its fields."""
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("k") % n + 1)
    failed = F.col("event_type") == "error"
    return (
        table(spark, sf_dir, "events")
        .select("event_id", F.col("user_id").alias("session_id"), "ts", "event_type", "value", k.alias("k"))
        .withColumn("seq", F.row_number().over(W.partitionBy("session_id").orderBy("ts", "event_id")).cast("long"))
        .select(
            "*",
            F.concat(F.lit("cmd_"), F.col("k").cast("string")).alias("command"),
            F.concat(at(COMMANDS, len(COMMANDS)), F.lit(" "), F.col("k").cast("string")).alias("full_command"),
            at(CATEGORIES, 5).alias("category"),
            failed.alias("is_failure"),
            F.when(failed, 1).otherwise(0).alias("exit_code"),
            F.lit("tool_call").alias("type"),
            F.concat(F.lit("src/file_"), (F.col("k") % 25).cast("string"), F.lit(".py")).alias("path"),
            F.col("k").alias("added"),
            (F.col("k") % 7).alias("removed"),
            F.when(F.col("k") % 3 > 0, F.col("event_type")).alias("status"),
            F.when(failed, F.concat(F.lit("error in module "), (F.col("k") % 20).cast("string"))).otherwise("").alias("error"),
        )
    )


#: The same two tables for DuckDB.
_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
MESSAGES_SQL = """m AS (
  SELECT conv_id AS session_id, turn AS seq, role, text AS content FROM conversations WHERE role IN ('user', 'assistant'))"""
TOOL_SQL = f"""t0 AS (
  SELECT event_id, user_id AS session_id, ts, event_type, value, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
  FROM events),
t AS (
  SELECT *, 'cmd_' || k AS command, {_LIST(COMMANDS)}[k % {len(COMMANDS)} + 1] || ' ' || k AS full_command, {_LIST(CATEGORIES)}[k % 5 + 1] AS category,
         event_type = 'error' AS is_failure, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code,
         'src/file_' || (k % 25) || '.py' AS path, k AS added, k % 7 AS removed,
         CASE WHEN k % 3 > 0 THEN event_type END AS status,
         CASE WHEN event_type = 'error' THEN 'error in module ' || (k % 20) ELSE '' END AS error
  FROM t0)"""
