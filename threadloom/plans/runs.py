"""Runs of named steps: each step's table is written under the run's id, and a ledger row says that it is done.

A run that is started again under its id goes on after its last finished step: tables with a ledger row are read back, a
table without one is written anew.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources.store import save_ledger

STEPS = "run_id string, seq int, state string, started timestamp, ended timestamp, detail string"
FAILED = "FAILED"


@dataclass
class Step:
    """A state that a run reaches: make takes the tables of the steps that it needs, by their names."""

    state: str
    make: Callable[..., DataFrame]
    needs: tuple[str, ...] = field(default=())


class Run:
    """A run's tables and ledger in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, run_id: str):
        self.spark, self.folder, self.id = spark, folder.rstrip("/"), run_id

    @property
    def ledger_path(self) -> str:
        return f"{self.folder}/ledger"

    def table_path(self, state: str) -> str:
        return f"{self.folder}/{self.id}/{state}"

    def ledger(self) -> DataFrame:
        """The run's rows, in order: seq, state, started, ended, detail (rows written, or what failed), duration_ms."""
        try:
            rows = self.spark.read.schema(f"{STEPS}, duration_ms long").parquet(self.ledger_path)
        except AnalysisException:  # no run has written a row yet
            rows = self.spark.createDataFrame([], f"{STEPS}, duration_ms long")
        return rows.filter(F.col("run_id") == self.id).orderBy("seq")

    def note(self, seq: int, state: str, started: datetime, detail: str) -> None:
        row = [(self.id, seq, state, started, datetime.now(timezone.utc), detail)]
        save_ledger(self.spark.createDataFrame(row, STEPS).coalesce(1), self.ledger_path)

    def go(self, steps: list[Step]) -> dict[str, DataFrame]:
        """All steps' tables by state.  What a step raises is noted as FAILED and raised on."""
        names = [s.state for s in steps]
        if len(set(names)) < len(names) or any(n not in names[:k] for k, s in enumerate(steps) for n in s.needs):
            raise ValueError("steps need distinct states, and only those before them")
        rows = self.ledger().select("seq", "state").collect()  # a row a step
        done, seq = {r["state"] for r in rows}, max((r["seq"] for r in rows), default=0)
        out: dict[str, DataFrame] = {}
        for step in steps:
            path = self.table_path(step.state)
            if step.state not in done:
                started, seq = datetime.now(timezone.utc), seq + 1
                try:
                    made = step.make(**{n: out[n] for n in step.needs})
                    made.write.mode("overwrite").parquet(path)
                    self.note(seq, step.state, started, str(self.spark.read.parquet(path).count()))
                except Exception as error:
                    self.note(seq, FAILED, started, f"{step.state}: {str(error)[:500]}")
                    raise
            out[step.state] = self.spark.read.parquet(path)
        return out
