"""Probes of the newest files, runs with a ledger, packages that appear at once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators import revise
from threadloom.plans.runs import FAILED, Run, Step
from threadloom.sources import log_source, probe
from threadloom.sources.json_log import log_files
from threadloom.sources.package_sink import PackageSink, packages_at

ID = "1111111{}-2222-3333-4444-555555555555"


@pytest.fixture
def logs(tmp_path):
    """Four rollouts, the fourth under a name that doesn't tell; the second says another id than its name."""
    for k in range(4):
        own = ID.format(k)
        meta = {"type": "session_meta", "timestamp": "2024-01-01T00:00:00Z", "payload": {"session_id": "other" if k == 1 else own, "cwd": f"/w{k}", "model": "m"}}
        said = {"type": "response_item", "timestamp": "2024-01-01T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": f"Please fix part {k}"}]}}
        late = {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "401 Unauthorized" if k > 1 else "fine"}]}}
        name = f"rollout-2024-01-0{k + 1}T00-00-00-{own}.jsonl" if k < 3 else "notes.jsonl"
        path = tmp_path / "logs" / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps(r) + "\n" for r in (meta, said, *[{"type": "turn_context", "payload": {"x": "y" * 2000}}] * 200, late)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(tmp_path / "logs")


def test_listing_reads_headers_of_the_newest(spark, logs, monkeypatch):
    asked = []
    monkeypatch.setattr(probe, "read_json_log", lambda spark, paths, most=None, f=probe.read_json_log, **k: asked.append((paths, most)) or f(spark, paths, most, **k))
    files = log_files(spark, logs)
    rows = probe.session_listing(spark, files, 2).collect()
    assert [(r["cwd"], r["title"], r["n_records"], r["n_user"]) for r in rows] == [("/w3", "Please fix part 3", None, None), ("/w2", "Please fix part 2", None, None)]
    assert len(asked[0][0]) == 2 and asked[0][1] == probe.LISTED_BYTES
    deep = probe.session_listing(spark, files, 10, deep=True).collect()
    assert [(r["session_id"], r["n_records"], r["n_user"]) for r in deep] == [(ID.format(3), 203, 2), (ID.format(2), 203, 2), ("other", 203, 2), (ID.format(0), 203, 2)]
    assert probe.session_listing(spark, files.limit(0)).count() == 0


def test_lookup_by_name_then_by_header(spark, logs):
    files = log_files(spark, logs)
    name = lambda wanted: [r["name"] for r in probe.found_session(spark, files, wanted).collect()]
    assert name(ID.format(0))[0].endswith(f"{ID.format(0)}.jsonl") and name("note") == ["notes.jsonl"]
    assert name("other")[0].endswith(f"{ID.format(1)}.jsonl") and name(ID.format(3)) == ["notes.jsonl"]
    assert name("nowhere") == [] and name(" ") == []


def test_evidence_of_the_newest(spark, logs, tmp_path):
    files = log_files(spark, logs)
    first = lambda k: tuple(probe.failed_logins(spark, files, k).first())
    assert first(2) == (2, 2, True) and first(5) == (4, 2, False)
    assert tuple(probe.failed_logins(spark, files.limit(0)).first()) == (0, 0, False)
    states = {}
    for k, (flag, text) in enumerate([(False, "hello"), (True, "Please LOGIN"), (True, "credit is out"), (True, "overloaded"), (None, None)]):
        folder = tmp_path / f"p{k}"
        folder.mkdir()
        rows = [{"type": "assistant", "message": "earlier"}, {"type": "assistant", "isApiErrorMessage": flag, "message": {"content": text}}] if text else []
        (folder / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [*rows, {"type": "user"}]))
        states[k] = probe.last_reply(spark, log_files(spark, str(folder))).first()["state"]
    assert list(states.values()) == ["fine", "login", "quota", "refused", "none"]


def test_run_goes_on_after_its_last_step(spark, tmp_path):
    made = []

    def step(name, n, fails=False):
        def make(**tables):
            made.append(name)
            if fails:
                raise RuntimeError("stopped")
            before = next(iter(tables.values()), None)
            return spark.range(n).toDF("x") if before is None else before.filter(F.col("x") < n)

        return make

    steps = lambda fails: [Step("PARSED", step("PARSED", 9)), Step("KEPT", step("KEPT", 5, fails), ("PARSED",)), Step("DONE", step("DONE", 2), ("KEPT",))]
    with pytest.raises(RuntimeError):
        Run(spark, str(tmp_path), "r1").go(steps(True))
    out = Run(spark, str(tmp_path), "r1").go(steps(False))
    assert made == ["PARSED", "KEPT", "KEPT", "DONE"] and out["DONE"].count() == 2
    Run(spark, str(tmp_path), "r1").go(steps(False))
    Run(spark, str(tmp_path), "r2").go(steps(False)[:1])
    rows = Run(spark, str(tmp_path), "r1").ledger().collect()
    assert [(r["seq"], r["state"], r["detail"].split(":")[0]) for r in rows] == [(1, "PARSED", "9"), (2, FAILED, "KEPT"), (3, "KEPT", "5"), (4, "DONE", "2")]
    assert revise.illegal_steps(Run(spark, str(tmp_path), "r1").ledger(), ["PARSED", "KEPT", "DONE"], [FAILED]).count() == 0
    with pytest.raises(ValueError):
        Run(spark, str(tmp_path), "r3").go([Step("A", step("A", 1), ("B",))])


def test_packages_appear_at_once(spark, tmp_path):
    spark.dataSource.register(PackageSink)
    path = str(tmp_path / "out")
    df = spark.range(10).select(F.concat(F.lit("mem/"), "id").alias("memory_id"), F.lit("codex").alias("agent"), F.col("id").cast("string").alias("session_id"), F.to_json(F.struct("id")).alias("document"))
    df.repartition(3).write.format("document_packages").mode("append").save(path)
    found = sorted(packages_at(path))
    assert len(found) == 10 and all(sorted(os.listdir(p)) == ["manifest.json", "memory.json", "source.json"] for p in found)
    manifest = json.load(open(f"{found[0]}/manifest.json"))
    assert manifest["memory_id"].startswith("mem/") and set(manifest["files"]) == {"memory.json", "source.json"}
    bad = df.withColumn("document", F.when(F.col("memory_id") == "mem/7", F.raise_error(F.lit("no"))).otherwise(F.col("document")))
    with pytest.raises(Exception, match="no"):
        bad.repartition(2).write.format("document_packages").mode("append").save(path)
    assert sorted(packages_at(path)) == found and not [x for x in os.listdir(path) if x.startswith("_staging")]
    df.limit(2).write.format("document_packages").mode("append").save(path)
    assert len(list(packages_at(path))) == 12


def test_no_file_is_opened_for_a_listing_of_names(spark, logs, monkeypatch):
    monkeypatch.setattr(log_source, "opened", lambda path: 1 / 0)
    assert len(log_source.files_below([logs], "rollout-*.jsonl")) == 3 and log_files(spark, logs).count() == 4
