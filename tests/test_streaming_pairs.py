"""The stream of pairs against the batch, over shuffled micro-batches and a restart."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources.events import with_calls
from threadloom.streaming.pairing import PROVIDER, paired_stream

SCHEMA = "session_id string, seq long, ts timestamp, type string, call_id string, tool_name string, command string, paths array<string>"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, out, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = paired_stream(stream, "30 seconds", 300_000).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)


def test_stream_of_pairs_is_the_batch(rocks, tmp_path):
    spark, r = rocks, random.Random(11)
    rows = []
    for session in "ab":
        for seq in range(60):
            kind = r.choice(["tool_call", "tool_result", "tool_result", "user_message"])
            call = kind == "tool_call"
            rows.append((session, seq, 1000 + seq, kind, r.choice(["c1", "c2", "c3", "", None]), f"t{seq}" if call else None, f"do {seq}" if call else None, [f"p{seq}"] if call else None))
    late = sorted(rows, key=lambda x: x[2] + r.uniform(0, 20))  # up to 20 seconds out of order
    parts = [late[k : k + 24] for k in range(0, len(late), 24)] + [[("z", 0, 10_000, "user_message", "q", None, None, None)], [("z", 1, 20_000, "tool_call", "q", None, None, None)], [("z", 2, 30_000, "tool_call", "q", None, None, None)]]
    folder = str(tmp_path / "in")
    for k, part in enumerate(parts):
        df = spark.createDataFrame(part, SCHEMA.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
        if k in (2, len(parts) - 1):  # the second time it starts anew from its checkpoint
            run(spark, folder, str(tmp_path / "out"), str(tmp_path / "state"))
    found = spark.read.parquet(str(tmp_path / "out"))
    got = sorted((x["session_id"], x["seq"], x["call_seq"], x["tool_name"], x["command"], x["state"]) for x in found.filter("session_id != 'z' and state != 'open'").collect())
    batch = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts long"))
    want = with_calls(batch).filter("type = 'tool_result' and coalesce(call_id, '') != ''").collect()
    assert got == sorted((x["session_id"], x["seq"], x["call_seq"], x["tool_name"], x["command"], "orphan" if x["call_seq"] is None else "paired") for x in want)
    taken = {(x[0], x[2]) for x in got}
    calls = {(x[0], x[1]) for x in rows if x[3] == "tool_call" and x[4]}
    assert {(x["session_id"], x["seq"]) for x in found.filter("session_id != 'z' and state = 'open'").collect()} == calls - taken
