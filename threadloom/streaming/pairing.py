"""Calls and results of a stream, in any order within the watermark, paired as in a batch.

A session's open calls and waiting results are keyed state.  A result waits until the watermark has passed its time: then
whatever is earlier has come, and the latest earlier call of its id is the one that a batch would find.  A result that has
none by then is an orphan; a call that no result took within `keep` is reported as open, and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.events import CALL, RESULT

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session_id string, seq long, call_id string, state string, call_seq long, tool_name string, command string, paths array<string>"
PAIRED, ORPHAN, OPEN = "paired", "orphan", "open"


class Pairs(StatefulProcessor):
    """Per session: calls by (call_id, seq), the seqs of each call_id, results by seq."""

    def __init__(self, keep_ms: int):
        self.keep = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "call_id string, seq long", "ms long, tool_name string, command string, paths array<string>, taken boolean")
        self.seqs = handle.getMapState("seqs", "call_id string", "seqs array<long>")
        self.results = handle.getMapState("results", "seq long", "ms long, call_id string, tool_name string, command string, paths array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        times = set()
        for r in rows:
            if r.type == CALL:
                own = [x for x in (self.seqs.getValue((r.call_id,)) or ([],))[0] if x != r.seq]
                self.seqs.updateValue((r.call_id,), (sorted([*own, r.seq]),))
                self.calls.updateValue((r.call_id, r.seq), (r.ms, r.tool_name, r.command, r.paths, False))
                times.add(r.ms + self.keep)
            else:
                self.results.updateValue((r.seq,), (r.ms, r.call_id, r.tool_name, r.command, r.paths))
                times.add(r.ms)
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        due = sorted((seq, tuple(v)) for (seq,), v in ((tuple(k), v) for k, v in self.results.iterator()) if v[0] <= now)
        for seq, (_, call_id, *own) in due:
            earlier = [x for x in (self.seqs.getValue((call_id,)) or ([],))[0] if x < seq]
            call_seq, found, state = None, own, ORPHAN
            if earlier:
                call_seq, state = earlier[-1], PAIRED
                ms, *call, _ = tuple(self.calls.getValue((call_id, call_seq)))
                self.calls.updateValue((call_id, call_seq), (ms, *call, True))
                found = [a if a is not None else b for a, b in zip(call, own)]
            out.append(Row(session_id=key[0], seq=seq, call_id=call_id, state=state, call_seq=call_seq, tool_name=found[0], command=found[1], paths=found[2]))
            self.results.removeKey((seq,))
        old = [(tuple(k), tuple(v)) for k, v in self.calls.iterator() if v[0] + self.keep <= now]
        for (call_id, seq), (_, tool_name, command, paths, taken) in sorted(old, key=lambda x: x[0][1]):
            if not taken:
                out.append(Row(session_id=key[0], seq=seq, call_id=call_id, state=OPEN, call_seq=seq, tool_name=tool_name, command=command, paths=paths))
            self.calls.removeKey((call_id, seq))
            left = [x for x in self.seqs.getValue((call_id,))[0] if x != seq]
            if left:
                self.seqs.updateValue((call_id,), (left,))
            else:
                self.seqs.removeKey((call_id,))
        return iter(out)


def paired_stream(events: DataFrame, within: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """A stream of events(session_id, seq, ts, type, call_id, tool_name, command, paths) as OUT rows.

    Rows may come in any order as long as they are within `within` of the latest ts; later ones are dropped by the
    watermark.  Events without a call_id take no part.  A call keeps its place for keep_ms of event time, which has to
    exceed the longest that a result may take.  Needs the RocksDB state store (`PROVIDER`).
    """
    kept = ["type", "call_id", "seq", "tool_name", "command", "paths", "ts"]
    wanted = events.filter(F.col("type").isin(CALL, RESULT) & (F.coalesce("call_id", F.lit("")) != ""))
    rows = wanted.withWatermark("ts", within).select(F.col("session_id").cast("string").alias("session_id"), *kept, F.unix_millis("ts").alias("ms"))
    return rows.groupBy("session_id").transformWithState(Pairs(keep_ms), OUT, outputMode="Append", timeMode="EventTime")
