"""Classifiers of tool events: by the tool's name, its command and its exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import BUILD_COMMANDS, EXPECTED_NONZERO, LINT_COMMANDS, TEST_COMMANDS, TOOL_CATEGORIES

#: One alternation each, so a command is matched against one pattern a class.
TEST, BUILD, LINT, SEARCH = ("(?i)" + "|".join(p) for p in (TEST_COMMANDS, BUILD_COMMANDS, LINT_COMMANDS, EXPECTED_NONZERO))


def command_class(command: Column) -> list[Column]:
    hit = lambda pattern: F.coalesce(F.rlike(command, F.lit(pattern)), F.lit(False))
    is_test = hit(TEST)
    return [is_test.alias("is_test"), (~is_test & hit(BUILD)).alias("is_build"), hit(LINT).alias("is_lint")]


def expected_nonzero(command: Column, code: Column) -> Column:
    """An exit code of 1 that is no failure."""
    return F.coalesce((code == 1) & F.rlike(command, F.lit(SEARCH)), F.lit(False))


def looked_up(tool: Column, categories: dict[str, list[str]]) -> Column:
    """The category that lists a tool's name, or null."""
    known = F.create_map(*[F.lit(x) for category, tools in categories.items() for tool_name in tools for x in (tool_name, category)])
    return F.try_element_at(known, F.lower(tool))


def tool_category(tool: Column, hint: Column | None = None) -> Column:
    hint = F.lit(None).cast("string") if hint is None else hint
    return F.coalesce(hint, looked_up(tool, TOOL_CATEGORIES), F.lit("tool_call"))


def call_category(tool: Column, command: Column, hint: Column | None = None) -> Column:
    """The category of a call: terminal commands are told apart as tests and builds."""
    category = tool_category(tool, hint)
    is_test, is_build, _ = command_class(command)
    terminal = category == "terminal"
    return F.when(terminal & is_test, "test").when(terminal & is_build, "build").otherwise(category)


def normalise_calls(calls: DataFrame) -> DataFrame:
    """Tool events with category, is_failure and significance: a failing search that found nothing is none."""
    category = call_category(F.col("tool_name"), F.col("command"))
    normal = expected_nonzero(F.col("command"), F.col("exit_code"))
    failed = F.coalesce(F.col("exit_code") != 0, F.col("is_failure"), F.lit(False)) & ~normal
    return calls.withColumn("category", category).withColumn("is_failure", failed).withColumn("significance", F.when(failed, 3).otherwise(1))
