"""The log formats, normalisation and documents over small logs made here, with their expected rows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import compress, memory, normalise, render
from threadloom.sources import bubble_kv, call_log, project_log, rollout
from threadloom.sources import events as sources
from threadloom.sources.formats import format_named
from threadloom.sources.json_log import find_session, log_files, newest_first, read_json_log, records_by_session

SCHEMA = "session_id string, seq long, record string, is_error boolean"
FILE = "lib/export.py"


def records(spark, log, session="s"):
    return spark.createDataFrame([(session, i, json.dumps(r) if r else None, r is None) for i, r in enumerate(log)], SCHEMA).repartition(3)


def item(n, payload, kind="response_item"):
    return {"timestamp": f"2026-03-01T10:00:{n:02d}.000Z", "ordinal": n, "type": kind, "payload": payload}


def said(n, role, text):
    return item(n, {"type": "message", "role": role, "content": [{"type": "text", "text": text}]})


def ran(n, command, output):
    return [
        item(n, {"type": "function_call", "name": "exec_command", "arguments": json.dumps({"cmd": command}), "call_id": f"c{n}"}),
        item(n + 1, {"type": "function_call_output", "call_id": f"c{n}", "output": output}),
    ]


def patch(line):
    return f"apply_patch <<'P'\n*** Begin Patch\n*** Update File: {FILE}\n@@\n-old\n+{line}\n*** End Patch\nP"


@pytest.fixture(scope="module")
def log():
    return [
        item(0, {"session_id": "s", "cwd": "/w", "cli_version": "1"}, "session_meta"),
        said(1, "developer", "be brief"),
        said(2, "user", "<environment_context>\nx"),
        said(3, "user", 'Exporting an empty table crashes. It printed {\n "rows": null\n}\nmake it write a header\n'),
        *ran(4, 'rg -n "header" lib', "Process exited with code 1\nOutput:\n"),
        item(6, {"type": "reasoning", "summary": [{"type": "summary_text", "text": "nothing writes a header yet"}]}),
        *ran(7, "npm run build", "Chunk ID: a\nWall time: 2.0 seconds\nProcess exited with code 0\nOutput:\nbuilt in 3s\n"),
        *ran(9, patch("new"), "Exit code: 0\nOutput:\nSuccess"),
        *ran(11, "pytest -q tests/test_export.py", "Process exited with code 1\nOutput:\nFAILED tests/test_export.py::test_empty - KeyError: 'rows'\n1 failed"),
        *ran(13, patch("newer"), "Exit code: 1\nOutput:\napply_patch verification failed: no such lines"),
        item(15, {"type": "turn_aborted", "reason": "interrupted"}, "event_msg"),
        item(16, {"type": "task_complete", "last_agent_message": "A header is written first now."}, "event_msg"),
        None,
        item(18, {"type": "token_count"}, "event_msg"),
        item(19, {"model": "m"}, "turn_context"),
        said(20, "assistant", "one more thing"),
    ]


@pytest.fixture(scope="module")
def normal(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("n") / "n")
    events = str(tmp_path_factory.mktemp("e") / "e")
    rollout.rollout_events(records(spark, log)).write.parquet(events)
    normalise.normalise(spark.read.parquet(events)).write.parquet(path)
    return spark.read.parquet(path)


def test_rollout(spark, log):
    rows = {r["seq"] // 1000: r for r in rollout.rollout_events(records(spark, log)).collect()}
    assert [rows[n]["type"] for n in (0, 3, 4, 5, 6)] == ["session_meta", "user_message", "tool_call", "tool_result", "reasoning"]
    assert 1 not in rows and 2 not in rows and len(rows) == 16
    assert rows[8]["result"] == "built in 3s" and rows[8]["exit_code"] == 0 and rows[8]["command"] == "npm run build" and rows[8]["call_seq"] == 7000
    assert rows[5]["result"] == "" and rows[5]["is_failure"]
    assert [tuple(f) for f in rows[9]["files"]] == [(FILE, "modified", 1, 1, 1)] and rows[9]["category_hint"] == "file_edit" and rows[10]["paths"] == [FILE]
    counters = rollout.rollout_counters(records(spark, log)).first()
    assert (counters["n_records"], counters["n_used"]) == (20, 16)
    assert counters["skipped"] == {"message/developer": 1, "injected": 1, "event_msg/token_count": 1, "turn_context": 1}
    session = rollout.rollout_sessions(records(spark, log)).first()
    assert (session["cwd"], session["model"], session["cli_version"], session["stated_id"]) == ("/w", "m", "1", "s")


def test_normalised(normal):
    rows = {r["seq"] // 1000: r for r in normal.collect()}
    assert len(rows) == 11
    assert (rows[7]["category"], rows[7]["type"], rows[7]["summary"], rows[7]["significance"]) == ("build", "test", "构建通过：npm run build", 2)
    assert not rows[4]["is_failure"] and rows[4]["nonzero_is_normal"] and rows[4]["significance"] == 1
    assert rows[11]["is_failure"] and rows[11]["summary"] == "测试失败：pytest -q tests/test_export.py" and rows[11]["significance"] == 3
    assert rows[9]["summary"] == f"修改文件：{FILE}（1 处，+1/-1）" and rows[13]["is_failure"]
    assert rows[15]["type"] == "error" and rows[15]["is_failure"] and rows[15]["reason"] == "interrupted"


def test_document(spark, normal):
    sessions = spark.createDataFrame([("s", "codex", "/w", "m")], "session_id string, agent string, cwd string, model string")
    project = spark.createDataFrame([("s", "/w", True, True, ["short"], 2)], "session_id string, cwd string, exists boolean, is_git boolean, constraints array<string>, n_changed int")
    doc = json.loads(memory.reconstruct(normal, sessions, project).select(F.to_json(F.struct("*"))).first()[0])
    assert doc["task"]["goal"] == "Exporting an empty table crashes. It printed make it write a header"
    assert (doc["task"]["status"], doc["task"]["confidence"], doc["task"]["constraints"]) == ("in_progress", "low", ["short"])
    assert [(a["action"], a["success"]) for a in doc["attempts"]] == [("pytest -q tests/test_export.py", False), (f"修改文件：{FILE}", False), ("npm run build", True)]
    assert doc["attempts"][0]["error"] == "FAILED tests/test_export.py::test_empty - KeyError: 'rows'"
    assert [(t["command"], t["status"]) for t in doc["validation"]["tests"]] == [("npm run build", "passed"), ("pytest -q tests/test_export.py", "failed")]
    assert doc["implementation"]["modified_files"] == [{"path": FILE, "summary": "修改 2 处（+2/-2），共 2 次编辑", "status": "modified"}]
    assert [i["priority"] for i in doc["unresolved"]] == ["high", "medium", "medium"] and len(doc["next_actions"]) == 2
    assert [r["description"] for r in doc["risks"]] == ["工作区存在 2 个未提交改动"]
    stats = doc["stats"]
    assert (stats["total_events"], stats["user_messages"], stats["tool_calls"], stats["failures"], stats["test_runs"], stats["edited_files"]) == (11, 1, 5, 2, 2, 1)
    assert stats["compression"] == {"input_events": 11, "_file_read_aggregated": 0, "kept_events": 11, "dropped": 0}


def test_open_failures_and_listed_steps(spark):
    def row(session, seq, command, failed, kind="terminal", content=None):
        return (session, seq, seq, kind, kind, command, failed, "boom error here" if failed else "", None, [], None, content, None)

    schema = "session_id string, seq long, ts long, type string, category string, command string, is_failure boolean, result string, exit_code int, paths array<string>, kind string, content string, summary string"
    rows = [row("1", 1, "a", True), row("1", 2, "a ", False)]
    rows += [row("2", 1, "a", True), *[row("2", n, "b", False) for n in range(2, 17)]]  # open, but before the tail
    rows += [row("3", 1, "a", True), *[row("3", n, "b", False) for n in range(2, 16)]]  # open, the first of the tail
    rows += [row("4", 1, "b", False), row("4", 2, None, False, "assistant_message", "Next:\n1. check the second file\n- the hook runs by itself\n2. run all tests again")]
    events = spark.createDataFrame(rows, schema)
    assert {r["session_id"]: r["status"] for r in memory.status(events).collect()} == {"1": "in_progress", "2": "in_progress", "3": "blocked", "4": "in_progress"}
    actions = sorted((r["session_id"], r["nth"], r["action"]) for r in memory.next_actions(events).collect())
    default = "复核当前改动并确认原任务是否已闭环"
    assert actions == [("1", 1, default), ("2", 1, default), ("3", 1, "排查并修复：a（当前报错：boom error here）"), ("4", 1, "check the second file"), ("4", 2, "run all tests again")]


def test_compression_drops_whole_tiers(spark, normal):
    state = lambda budget: {r["seq"] // 1000: r["state"] for r in compress.compressed(normal, budget).collect()}
    everything, some, least = state(10_000), state(150), state(1)
    assert set(everything.values()) == {"kept"}
    assert {n for n, s in some.items() if s != "kept"} <= {n for n, s in least.items() if s != "kept"}
    assert least[3] == "kept" and least[11] == "kept" and least[15] == "kept" and least[6] == "dropped_low_significance" and least[16] == "dropped_medium_significance"
    bundle = compress.bundles(normal, 1).first()
    assert bundle["truncated"] and bundle["stats"]["dropped"] == sum(s != "kept" for s in least.values())


def test_reads_are_collapsed(spark):
    rows = [("s", n, n, "file_read", "file_read", None, "", "", 1, n == 6, [f"f{n}"], None) for n in range(1, 7)] + [("s", 7, 7, "terminal", "terminal", "x", "", "", 2, False, [], "ls")]
    schema = "session_id string, seq long, ts long, type string, category string, summary string, content string, result string, significance int, is_failure boolean, paths array<string>, command string"
    out = compress.with_collapsed_reads(spark.createDataFrame(rows, schema)).collect()
    read = next(r for r in out if r["category"] == "file_read")
    assert len(out) == 2 and read["is_failure"] and read["n_reads"] == 6 and read["summary"] == "共读取/检索 6 次，涉及文件：f1、f2、f3、f4、f5、f6"
    assert read["place"]["seq"] == -1


def test_project_log(spark):
    call = {"type": "tool_use", "id": "toolu_12345678", "name": "Bash", "input": {"command": "npm test"}}
    log = [
        {"type": "user", "uuid": "u1", "timestamp": "2026-03-01T10:00:00Z", "sessionId": "S", "cwd": "/w", "message": {"role": "user", "content": "do it"}},
        {"type": "queue-operation"},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "uuid": "u2", "message": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, call, {"type": "text", "text": "two"}]}},
        {"type": "user", "uuid": "u3", "toolUseResult": {"stderr": "bad"}, "message": {"content": [{"type": "tool_result", "tool_use_id": "toolu_12345678", "is_error": True, "content": [{"type": "text", "text": "boom"}]}]}},
        {"type": "assistant", "uuid": "u5", "isSidechain": True, "message": {"content": "side"}},
        {"type": "assistant", "uuid": "u6", "isApiErrorMessage": True, "message": {"content": [{"type": "text", "text": "Not logged in"}, call]}},
        {"type": "summary", "summary": "sum"},
        {"type": "user", "message": {"content": "<system-reminder> x"}},
    ]
    rows = sorted(project_log.project_log_events(records(spark, log)).collect(), key=lambda r: r["seq"])
    assert [(r["seq"], r["type"]) for r in rows] == [
        (0, "user_message"), (3000, "assistant_message"), (3001, "reasoning"), (3003, "tool_call"), (4001, "tool_result"), (6000, "error"), (7000, "session_meta"),
    ]
    assert rows[1]["content"] == "ok\n\ntwo" and rows[3]["event_id"] == "claude:u2:12345678:tool_call" and rows[3]["category_hint"] == "terminal"
    assert rows[4]["command"] == "npm test" and rows[4]["exit_code"] == 1 and rows[4]["is_failure"] and rows[4]["result"] == "boom"
    counters = project_log.project_log_counters(records(spark, log)).first()
    assert counters["skipped"] == {"queue-operation": 1, "injected": 2, "sidechain": 1}
    assert project_log.project_log_sessions(records(spark, log)).first()["cwd"] == "/w"


def test_call_log(spark):
    log = [
        {"id": "1", "timestamp": 1700000000000, "type": "message", "role": "user", "content": [{"text": "<system-reminder>x</system-reminder><user_query> real </user_query>"}]},
        {"id": "2", "type": "message", "role": "user", "content": [{"text": "<user_info> only"}]},
        {"id": "3", "type": "reasoning", "rawContent": [{"text": "a"}, {"text": "b"}]},
        {"id": "4", "type": "function_call", "name": "Write", "callId": "c", "arguments": json.dumps({"file_path": "x.py"})},
        {"id": "5", "type": "function_call_result", "callId": "c", "status": "completed", "output": [{"text": "fine\n[ERROR] no"}]},
        {"id": "6", "type": "function_call_result", "callId": "zz", "status": "aborted", "output": "x"},
        {"type": "snapshot"},
    ]
    rows = sorted(call_log.call_log_events(records(spark, log)).collect(), key=lambda r: r["seq"])
    assert [(r["type"], r["content"], r["is_failure"]) for r in rows if r["type"] != "tool_call"] == [
        ("user_message", "real", None), ("reasoning", "a\nb", None), ("tool_result", "fine\n[ERROR] no", True), ("tool_result", "x", True),
    ]
    assert rows[2]["paths"] == ["x.py"] and rows[3]["paths"] == ["x.py"] and rows[3]["call_seq"] == 3000 and rows[4]["call_seq"] is None
    assert sources.unmatched(call_log.call_log_events(records(spark, log))).first()["n_unmatched"] == 1


def test_databases(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "state.vscdb")
    con.execute("CREATE TABLE composerHeaders (composerId TEXT, workspaceId TEXT, createdAt INTEGER, lastUpdatedAt INTEGER, isArchived INTEGER, isSubagent INTEGER)")
    con.execute("CREATE TABLE cursorDiskKV (key TEXT PRIMARY KEY, value BLOB)")
    con.executemany("INSERT INTO composerHeaders VALUES (?, 'w', 1, ?, 0, 0)", [("a", 5), ("b", 9), ("empty-state-draft", 1)])
    rich = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "fix "}, {"type": "text", "text": "it"}]}]})
    bubbles = {
        "z1": {"type": 1, "bubbleId": "z1", "createdAt": "2026-03-01T10:00:00Z", "richText": rich},
        "a2": {"type": 2, "bubbleId": "a2", "createdAt": "2026-03-01T10:00:05Z", "text": "done", "thinking": {"text": "hm"}, "assistantSuggestedDiffs": [{"path": "p.py", "diff": "@@\n-a\n+b\n+c"}], "toolResults": [{"name": "t", "result": {"x": 1}, "isError": True}]},
    }
    values = [("composerData:a", json.dumps({"name": "N", "modelConfig": {"modelName": "m"}}).encode()), ("bubbleId:a:bad", b"{")]
    values += [(f"bubbleId:a:{k}", json.dumps(v).encode()) for k, v in bubbles.items()]
    con.executemany("INSERT INTO cursorDiskKV VALUES (?, ?)", values)
    con.commit()
    con.close()
    (tmp_path / "broken.vscdb").write_bytes(b"no database")
    rows = bubble_kv.read_databases(spark, str(tmp_path))
    assert rows.filter("kind = 'error'").count() == 1
    listing = bubble_kv.sessions(rows).collect()
    assert [(r["composer_id"], r["n_bubbles"], r["n_user"], r["name"], r["model"]) for r in listing] == [("a", 2, 1, "N", "m")]
    events = sorted(bubble_kv.bubble_events(bubble_kv.bubbles_in_order(rows)).collect(), key=lambda r: r["seq"])
    assert [(r["type"], X and r["content"]) for r in events[:3]] == [("user_message", "fix it\n"), ("reasoning", "hm"), ("assistant_message", "done")]
    assert [tuple(f) for f in events[3]["files"]] == [("p.py", "modified", 1, 2, 1)] and events[4]["is_failure"] and json.loads(events[4]["result"]) == {"x": 1}


def test_files_of_a_format(spark, tmp_path):
    day = tmp_path / "sessions" / "2026"
    day.mkdir(parents=True)
    id_ = "0199a213-81c0-7800-8aa1-bbab2a035a53"
    (day / f"rollout-2026-03-01T10-00-00-{id_}.jsonl").write_text(json.dumps(said(1, "user", "hello")) + "\n{\n" + json.dumps(said(2, "assistant", "yes"))[1:] + "\nbroken\n")
    (day / "other.jsonl").write_text("{}")
    files = log_files(spark, str(tmp_path), format_named("rollout").pattern)
    assert [(r["session_id"], r["archived"]) for r in newest_first(files, 5).collect()] == [(id_, False)]
    assert find_session(files, id_).count() == 1 and find_session(files, "0199a213").count() == 1 and find_session(files, "zz").count() == 0
    rows = records_by_session(read_json_log(spark, str(tmp_path), pattern="rollout-*.jsonl"), files)
    assert sorted((r["session_id"], r["type"]) for r in rollout.rollout_events(rows).collect()) == [(id_, "assistant_message"), (id_, "user_message")]
    assert rows.filter("is_error").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        format_named("nothing")


def test_text_functions(spark):
    def run(f, *values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
        return [r["o"] for r in df.select("i", f(F.col("t")).alias("o")).orderBy("i").collect()]

    assert run(X.clean_user_text, "see [a](http://x.y) and http://z.q ```code\nx``` end", "a [1,2] b", "x {a [ b\n] c\n} d\nlast", None) == ["see a and end", "a [1,2] b", "x\nlast", ""]
    assert run(X.without_envelope, "Chunk ID: a\nOutput:\nBUILD\nOutput:\nx", "Process exited with code 0\nOutput:", " plain ") == ["BUILD\nOutput:\nx", "", "plain"]
    assert run(X.first_error_line, "Process exited with code 1\nerror: gone", "FullName\n----\nC:/a.jar", "x\nundefined y", "\x1b[31mError\x1b[0m z") == ["error: gone", "", "undefined y", "Error z"]
    assert run(lambda c: X.looks_failed(X.exit_code(c), c), "Exit code: 0\nerror", "ok\nfine\nbla\nerror", "no such file or directory") == [False, False, True]
    assert run(X.unwrapped_prompt, "你正在继续一个已经进行中的开发任务。\n\n## 任务目标\n\nrepair\n\n## 执行要求\n\n1", "x") == ["repair", None]
    assert run(X.title_of, "# Files mentioned by the user\n```\n## ok go\n", "") == ["ok go", None]
    assert run(X.decoded_folder, "C--a-b", "x-y", "") == ["C:\\a\\b", "x-y", None] and run(X.decoded_workspace, "c-Users-x", "ab") == ["C:\\Users\\x", "ab"]
    assert run(lambda c: X.human_size(c.cast("long")), "10", "2048", "5000000") == ["10 B", "2.0 KB", "4.8 MB"]
    assert run(lambda c: F.to_json(X.json_object(c)), '```json\n{"a": 1}\n```', 'so: {"b": 2} end', "[1]", "none") == ['{"a":1}', '{"b":2}', None, None]
    assert run(lambda c: X.iso_time(c).cast("string"), "2026-03-01T10:00:00Z", "2026-03-01 10:00:00", "x") == ["2026-03-01 10:00:00", "2026-03-01 10:00:00", None]
    assert run(lambda c: X.start_failure(F.split(c, "[|]")), "a: no|b: no", "a: x|b: y") == ["启动失败：no（2 种创建方式均被拒绝）", "启动失败：a: x；b: y"]


@pytest.fixture(scope="module")
def document(spark, normal, tmp_path_factory):
    sessions = spark.createDataFrame([("s", "codex", "/w", "m")], "session_id string, agent string, cwd string, model string")
    project = spark.createDataFrame([("s", "/w", True, True, ["short"], 2)], PROJECT)
    path = str(tmp_path_factory.mktemp("d") / "d")
    memory.reconstruct(normal, sessions, project).write.parquet(path)
    return spark.read.parquet(path), project


PROJECT = "session_id string, cwd string, exists boolean, is_git boolean, constraints array<string>, n_changed int"


def test_patches(spark, document):
    from threadloom.operators import revise

    doc, _ = document
    patch = {
        "task": {"title": "A better title", "goal": "", "status": "blocked"},
        "attempts": [{"action": "PYTEST -q tests/test_export.py ", "result": "failed", "success": False}, {"action": "", "result": "x"}, {"result": "no action"}],
        "next_actions": [{"action": "second", "priority": 7}, {"action": "first", "priority": 0}], "risks": [], "implementation": {"completed": [" ", "wrote it"], "modified_files": [{"path": FILE}]},
        "validation": {"tests": [{"command": "invented", "status": "passed"}]}, "git": {"branch": "x"},
    }
    rows = revise.merge_patches(doc, spark.createDataFrame([("s", json.dumps(patch))], "session_id string, patch string"))
    r = rows.first()
    assert (r["task"]["title"], r["task"]["goal"], r["task"]["status"], r["task"]["confidence"]) == ("A better title", doc.first()["task"]["goal"], "blocked", "high")
    assert [a["action"] for a in r["attempts"]] == ["PYTEST -q tests/test_export.py ", f"修改文件：{FILE}"]
    assert [(a["action"], a["priority"]) for a in r["next_actions"]] == [("first", 2), ("second", 7)]
    assert r["implementation"]["completed"] == ["wrote it"] and r["implementation"]["modified_files"][0]["summary"] == "修改 2 处（+2/-2），共 2 次编辑"
    assert len(r["risks"]) == 1 and r["unknown_fields"] == ["$.git"] and [t["command"] for t in r["validation"]["tests"]] == ["npm run build", "pytest -q tests/test_export.py"]
    facts = revise.compared(revise.fact_fields(doc), revise.fact_fields(rows))
    assert revise.facts_agree(facts).first()["invariant"]
    diff = {x["field"]: x["delta"] for x in revise.compared(revise.semantic_fields(doc), revise.semantic_fields(rows)).collect()}
    assert diff["task.title"] == "不同" and diff["task.goal"] == "一致" and diff["attempts（条）"] == "-1"
    assert "| attempts（条） | 3 | 2 | -1 |" in revise.comparison_text(revise.compared(revise.semantic_fields(doc), revise.semantic_fields(rows))).first()["text"]
    nothing = revise.merge_patches(doc, spark.createDataFrame([("s", "no json")], "session_id string, patch string")).drop("unknown_fields")
    assert nothing.select(*doc.columns).collect() == doc.collect()


def test_patched_tests_are_no_facts(spark, document):
    from threadloom.operators import revise

    doc, _ = document
    none = doc.withColumn("validation", F.col("validation").withField("tests", F.slice("validation.tests", 1, 0)))
    told = [{"command": "a"}, {"command": "b", "status": "lost"}, {"command": "c", "source": "program"}, {"status": "passed"}]
    patch = {"validation": {"tests": told, "lint": ["ruff"], "x": 1}, "task": {"goal": "g", "mood": {"deep": 1}}, "risks": [{"description": "r", "odds": 1}, {"description": "s"}], "conversation": {"user_preferences": ["short"]}, "attempts": [{"action": "x"}]}
    row = revise.merge_patches(none, spark.createDataFrame([("s", json.dumps(patch))], "session_id string, patch string"), "llm:m")
    r = row.first()
    assert [(t["command"], t["status"], t["source"]) for t in r["validation"]["tests"]] == [("a", "passed", "llm")]
    assert sorted(r["unknown_fields"]) == ["$.risks[0].odds", "$.task.mood", "$.validation.tests[2].source", "$.validation.x"]
    assert [x["description"] for x in r["risks"]] == ["s"] and r["task"]["reconstructed_by"] == "llm:m" and r["conversation"]["user_preferences"] == ["short"]
    assert r["attempts"][0]["success"] is False and len(r["attempts"]) == 3
    facts = revise.compared(revise.fact_fields(none), revise.fact_fields(row))
    assert facts.count() == 10 and revise.facts_agree(facts).first()["invariant"]
    semantic = {x["field"]: (x["a"], x["b"], x["delta"]) for x in revise.compared(revise.semantic_fields(none), revise.semantic_fields(row)).collect()}
    assert len(semantic) == 20 and semantic["validation.tests LLM 补充线索（条）"] == ("0", "1", "+1") and semantic["reconstructed_by"][2] == "不同"
    twice = revise.compared(revise.fact_fields(doc), revise.fact_fields(none))
    assert not revise.facts_agree(twice).first()["invariant"]


def test_fact_sections(spark, normal):
    from threadloom.operators import memory

    sessions = spark.createDataFrame([("s", "codex", "/p", "m")], "session_id string, agent string, cwd string, model string")
    project = spark.createDataFrame([("s", "/p", True, True, [], 0, ["z.py", "a.py"], "main", ["Python"])], "session_id string, cwd string, exists boolean, is_git boolean, constraints array<string>, n_changed int, changed_files array<string>, branch string, languages array<string>")
    commands = spark.createDataFrame([("s", ["ls"])], "session_id string, recent_commands array<string>")
    r = memory.facts(sessions, project, commands).first()
    assert (r["git"]["changed_files"], r["git"]["has_uncommitted_changes"], r["git"]["branch"], r["git"]["commit"]) == (["a.py", "z.py"], True, "main", None)
    assert r["project"]["language"] == ["Python"] and r["project"]["framework"] == [] and r["runtime"]["recent_commands"] == ["ls"] and r["metadata"]["source_agent"] == "codex"


def test_extracted_patches(spark):
    from threadloom.operators import extract

    digest = "\n".join([
        "no event", "[02-01 10:00] USER_MESSAGE   先修复登录。然后测试", "           └─ 先修复登录。然后测试", "[--] USER_MESSAGE   先修复登录。再来", "[02-01 10:01] ASSISTANT_MESSAGE 我决定采用新的缓存方案。短",
        "[02-01 10:02] FILE_EDIT      修改文件：src/a.py（1 处，+2/-1）；src/b.tsx", "[02-01 10:03] TEST           测试失败：pytest -q  ⚠失败", "           └─ AssertionError: 1", "           └─ second",
        "[02-01 10:04] BUILD          构建通过：make", "[02-01 10:05] TERMINAL       执行命令：ls  ⚠失败", "[02-01 10:06] FILE_EDIT      修改文件：src/a.py",
    ])
    rows = extract.extracted_patches(spark.createDataFrame([("s", digest), ("e", "（无事件）"), ("n", None)], "session_id string, digest string"))
    found = {r["session_id"]: json.loads(r["patch"]) for r in rows.collect()}
    p = found["s"]
    assert p["task"]["title"] == "先修复登录" and p["task"]["goal"] == "先修复登录。然后测试" and p["task"]["requirements"] == ["先修复登录"] and p["task"]["status"] == "blocked"
    assert [f["path"] for f in p["implementation"]["modified_files"]] == ["src/a.py", "src/b.ts"] and p["implementation"]["completed"] == ["修改了 2 个文件", "通过验证：构建通过：make"]
    assert [(a["action"], a.get("error"), a["success"]) for a in p["attempts"]] == [("测试失败：pytest -q", "AssertionError: 1", False), ("执行命令：ls", None, False)]
    assert [d["decision"] for d in p["decisions"]] == ["我决定采用新的缓存方案"]
    assert [(i["description"], i["priority"]) for i in p["unresolved"]] == [("仍未解决：AssertionError: 1", "high"), ("仍未解决：执行命令：ls", "medium")] and [a["priority"] for a in p["next_actions"]] == [1, 2]
    assert p["conversation"]["summary"] == "会话包含 2 条用户消息、3 次命令执行，其中 2 次失败。"
    for k in "en":
        assert found[k]["task"] == {"background": p["task"]["background"], "requirements": [], "constraints": [], "status": "in_progress"} and found[k]["attempts"] == []


def test_checks(spark, document):
    from threadloom.operators import revise

    doc, project = document
    assert {(c["check"], c["level"]) for c in revise.checks(doc, project).collect()} == set()
    bad = doc.withColumn("task", F.col("task").withField("title", F.lit(" ")).withField("goal", F.lit("unknown")))
    gone = spark.createDataFrame([("s", "/gone", False, False, [], 0)], PROJECT)
    assert {(c["check"], c["level"]) for c in revise.checks(bad, gone).collect()} == {("title", "error"), ("goal", "error"), ("path", "warning"), ("git", "warning")}
    changes = spark.createDataFrame([("s", ["a\\b"], ["c"])], "session_id string, real array<string>, claimed array<string>")
    assert [c["what"] for c in revise.checks(doc, project, changes).collect()] == ["changes differ"]
    files = spark.createDataFrame([("s", "src/Other.java")], "session_id string, path string")
    assert [r["path"] for r in revise.missing_files(doc, files).collect()] == [FILE]
    assert revise.missing_files(doc, files.union(spark.createDataFrame([("s", FILE)], files.schema))).count() == 0


def test_rendering(document):
    import re


    doc, _ = document
    text = render.as_markdown(doc, "now", "the writer").first()["markdown"]
    titles = re.findall(r"^## (\d+)\. (.+)$", text, re.M)
    golden = ["# 任务记忆（Canonical Memory）", "", "> 本文件由 **the writer** 生成，用于让接续的 Agent 直接恢复任务状态，不必重新分析已完成的工作。", "", "## 0. 元信息", "", "| 项 | 值 |", "| --- | --- |", "| memory_id | `unknown` |",
        "| 来源 Agent | codex |", "| 来源会话 | `s` |", "| 协议版本 | 1.0 |", "| 生成时间 | now |", "| 重建方式 | heuristic |", "| 置信度 | 低 |", "", "## 1. 任务", ""]
    assert text.split("\n")[: len(golden)] == golden
    for part in ("- **状态**：进行中", "### 需求\n\n- Exporting an empty table crashes", "### 约束\n\n- short\n", f"| `{FILE}` | 修改 | 修改 2 处（+2/-2），共 2 次编辑 |", "| `npm run build` | ✅ 通过 | 程序解析 | built in 3s |",
        "- 构建：passed（`npm run build`）", "- **[高] 测试/构建失败：FAILED", "  - 推测原因：", "   - 依据：", "  - 影响：", "（无 Git 信息）\n\n> 说明：", "- 工作目录：`/w`\n- 操作系统：unknown\n- Shell：unknown\n- 最近执行的命令：\n  - `"):
        assert part in text, part
    assert text.endswith("真实文件系统 > Git 状态 > 运行时状态 > 本 Memory > 会话摘要\n```\n")
    assert [int(n) for n, _ in titles] == list(range(12)) and ("4", "已尝试但失败的方案 ⚠") in titles and "| # | 动作 |" in text
    fewer = render.as_markdown(doc.withColumn("risks", F.slice("risks", 1, 0))).first()["markdown"]
    assert "风险提示" not in fewer and [int(n) for n, _ in re.findall(r"^## (\d+)\. (.+)$", fewer, re.M)] == list(range(11))
    prompt = render.initial_prompt(doc, "@memory.md").first()["prompt"]
    assert "@memory.md" in prompt and "不要重复已经失败的方案" in prompt
    assert normalise and doc.select(X.unwrapped_prompt(F.lit(prompt)).alias("g")).first()["g"] == doc.first()["task"]["goal"]


def test_ids_and_ledger(spark):
    from threadloom.operators import revise

    ids = revise.next_ids(spark.createDataFrame([("b",), ("a",)], "name string"), spark.createDataFrame([("mem_20260301_007",), ("mem_20260228_100",)], "id string"), "20260301", "name")
    rows = ids.collect()
    assert {r["name"] for r in rows} == {"a", "b"} and {r["id"] for r in rows} == {"mem_20260301_008", "mem_20260301_009"}
    steps = [(1, 1, "init"), (1, 2, "parse"), (1, 3, "failed"), (1, 4, "init"), (2, 1, "parse"), (2, 2, "init"), (2, 3, "done")]
    found = revise.illegal_steps(spark.createDataFrame(steps, "run_id int, seq int, state string"), ["init", "parse", "done"], ["failed"]).collect()
    assert [tuple(r) for r in found] == [(2, 2, "parse", "init")]


def test_contexts_and_listings(spark, document, normal):
    from threadloom.operators import revise

    doc, _ = document
    full = render.inline_context(doc, "memory.md", "mark", tool="the writer").first()["context"]
    assert full.startswith("<!-- mark:begin -->\n# 接续任务上下文（由 the writer 生成）\n\n本项目") and full.endswith("\n如本段描述与当前代码或 Git 状态冲突，**以真实文件与 Git 为准**。\n<!-- mark:end -->") and "\n- 项目：/w\n" in full
    assert full.index("## 任务") < full.index("## 已尝试且失败的方案（不要重复）") < full.index("## 下一步") < full.index("## 已完成") and "`memory.md`" in full and len(full) <= 2600
    small = render.inline_context(doc, "memory.md", budget=470).first()["context"]
    assert "## 任务" in small and "## 已尝试且失败的方案（不要重复）" not in small and len(small) <= 500
    prompt = render.prompt_text(compress.bundles(normal), doc, 40).first()["prompt"]
    assert prompt.startswith("## 来源\n- Agent：codex\n- Session：s\n\n## 项目真实状态（优先于对话描述）\n- 路径：/w\n- 名称：unknown\n- 语言：unknown") and "## Git 状态\n- 分支：unknown" in prompt
    assert "[03-01 10:00] META" in prompt and "BUILD" not in prompt and prompt.endswith('"mitigation": "string|null"\n    }\n  ]\n}\n```')
    b = revise.brief(doc).first()
    assert (b["status"], b["n_attempts"], b["n_failed"], b["n_tests"], b["n_files"]) == ("in_progress", 3, 2, 2, 1)
    assert revise.with_sections(doc, conversation=False, risks=True).first()["conversation"] is None


def test_store(spark, document, tmp_path):
    from threadloom.operators import revise
    from threadloom.sources import store

    doc, _ = document
    key = "sk-" + "abcdefghij" * 3
    rows = spark.createDataFrame([("a", "s/1", n, json.dumps({"k": key, "n": n}), False) for n in range(5)] + [("b", "s", 0, None, True)], "agent string, session_id string, seq long, record string, is_error boolean")
    store.save_snapshot(rows, str(tmp_path / "raw"))
    back = store.snapshot(spark, str(tmp_path / "raw"), 3)
    assert back.count() == 4 and {r["session_id"] for r in back.collect()} == {"s_1", "s"} and not back.filter(F.contains("record", F.lit(key))).count()
    made = doc.join(render.as_markdown(doc), "session_id").withColumns({"memory_id": F.lit("mem_20260301_001"), "created": F.lit("2026-03-01").cast("timestamp")})
    store.save_documents(made, str(tmp_path / "docs"))
    listed = store.catalogue(spark, str(tmp_path / "docs")).first()
    assert listed["memory_id"] == "mem_20260301_001" and listed["size"] > 500
    found = store.document(spark, str(tmp_path / "docs"), "mem_20260301_001").first()
    assert json.loads(found["document"])["task"]["status"] == "in_progress" and found["markdown"].startswith("# ")
    assert store.document(spark, str(tmp_path / "docs"), "none").count() == 0
    with pytest.raises(LookupError):
        store.document(spark, str(tmp_path / "docs"), "none", must_exist=True)
    assert (listed["source_agent"], listed["session_id"], listed["status"], listed["title"]) == ("codex", "s", "in_progress", doc.first()["task"]["title"]) and listed["path"].endswith(".parquet") and len(listed) == 8
    shown = revise.report_document(made)
    assert len(shown.columns) == 20 and shown.first()["memory_id"] == "mem_20260301_001" and shown.first()["project"]["path"] == "/w"
    report = revise.report_rows({"memories": (shown, ["memory_id"]), "numbers": (spark.range(9), [F.desc("id")])}, 3).collect()
    assert [(r["section"], r["nth"]) for r in report] == [("memories", 1), ("numbers", 1), ("numbers", 2), ("numbers", 3)] and json.loads(report[1]["item"]) == {"id": 8}
    at = lambda s: F.lit(s).cast("timestamp")
    steps = spark.createDataFrame([(1, 1, "init"), (1, 2, "done"), (2, 1, "failed")], "run_id int, seq int, state string")
    store.save_ledger(steps.withColumns({"started": at("2026-03-01 10:00:00"), "ended": at("2026-03-01 10:00:02"), "detail": F.lit("")}), str(tmp_path / "ledger"))
    assert sorted((r["run_id"], r["state"], r["duration_ms"]) for r in store.ledger(spark, str(tmp_path / "ledger")).collect()) == [(1, "done", 4000), (2, "failed", 2000)]


def test_texts_and_status(spark, tmp_path):
    from threadloom.sources import store

    for name, data in {"u": "é中".encode(), "b": b"\xef\xbb\xbfx", "g": "中文".encode("gbk"), "l": b"\xff\xff\x80"}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r["path"][-5]: r["text"] for r in store.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"u": "é中", "b": "x", "g": "中文", "l": "\xff\xff\x80"}
    status = ' M src/a.py\nR  old.py -> "new name.py"\n?? extra.txt\n\n'
    df = spark.createDataFrame([(status,)], "t string")
    assert [tuple(x) for x in df.select(store.status_lines(F.col("t")).alias("s")).first()["s"]] == [(" M", "src/a.py", False), ("R ", "new name.py", False), ("??", "extra.txt", True)]
