"""Readers and streams."""

import json


def test_values_over_several_lines(spark, tmp_path):
    from threadloom.sources.json_log import read_json_log

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{\n "b":\n 2\n}\nbroken {\n[1]\n{"c": 3, "c": 4}\n')
    rows = read_json_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["record"], r["is_error"]) for r in rows] == [('{"a": 1}', False), ('{"b": 2}', False), (None, True), (None, True), ('{"c": 4}', False)]


def test_stream(spark, tmp_path):
    from threadloom.streaming.calls import rolling_counts, without_repeats

    schema = "session_id long, ts timestamp, call_id string, is_failure boolean"
    df = spark.sql("select 1L session_id, timestamp'2024-01-01 00:00:01' ts, 'a' call_id, true is_failure union all select 1L, timestamp'2024-01-01 00:00:02', 'a', true union all select 1L, timestamp'2024-01-01 00:10:00', 'b', false")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, out, mode in (("once", without_repeats(stream(), ["session_id", "call_id"]), "append"), ("counts", rolling_counts(stream()), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("once").count() == 2
    assert [(r["n_events"], r["n_failures"]) for r in spark.table("counts").collect()] == [(3, 2)]
