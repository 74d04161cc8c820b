"""The log formats by name: where their files lie, and how records become events, counters and sessions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.tables import united
from . import call_log, project_log, rollout


@dataclass(frozen=True)
class LogFormat:
    name: str
    pattern: str
    events: Callable[[DataFrame], DataFrame]
    counters: Callable[[DataFrame], DataFrame]
    sessions: Callable[[DataFrame], DataFrame]


FORMATS = {
    f.name: f
    for f in (
        LogFormat("rollout", "rollout-*.jsonl", rollout.rollout_events, rollout.rollout_counters, rollout.rollout_sessions),
        LogFormat("project-log", "*.jsonl", project_log.project_log_events, project_log.project_log_counters, project_log.project_log_sessions),
        LogFormat("call-log", "*.jsonl", call_log.call_log_events, call_log.call_log_counters, call_log.call_log_sessions),
    )
}
#: Formats that are known and not read yet.
PLANNED: list[str] = []


def format_named(name: str) -> LogFormat:
    if name in FORMATS:
        return FORMATS[name]
    state = "planned, but not read yet" if name in PLANNED else f"unknown; known are {', '.join(sorted(FORMATS))}"
    raise ValueError(f"log format {name!r} is {state}")


def events_of(records: dict[str, DataFrame]) -> DataFrame:
    """The events of several formats' records in one table."""
    return united(*[format_named(name).events(rows) for name, rows in records.items()])
