"""Every query of the session log engine beside its SQL, on the smallest tables."""

import pytest

from tests.oracle import compared
from threadloom.functions import text as X
from threadloom.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in ORACLE_SQL:
        own, want = compared(spark, SF, QUERIES[name], ORACLE_SQL[name])
        assert own == want
    else:  # tests/test_redact.py and tests/test_logs.py hold golden values for these
        assert QUERIES[name](spark, SF).count() > 0


def test_result_before_its_call_is_an_orphan(spark):
    from threadloom.operators import pairing

    rows = [(1, 1, "result", "a", 1.0), (1, 2, "call", "a", 0.0), (1, 3, "result", "a", 2.0), (1, 4, "call", "a", 0.0), (1, 5, "result", "a", 3.0), (1, 6, "result", None, 4.0)]
    seen = pairing.with_call_seq(spark.createDataFrame(rows, "session_id long, seq long, kind string, call_id string, value double"))
    assert [r["call_seq"] for r in seen.filter("kind = 'result'").orderBy("seq").collect()] == [None, 2, 4, None]


def test_upsert_twice_changes_nothing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), ("head",), ("head\n<!-- a -->\nold\n<!-- b -->\ntail",)], "d string")
    put = lambda c: X.upsert_section(c, F.lit("new"), "<!-- a -->", "<!-- b -->")
    for r in df.withColumn("once", put(F.col("d"))).withColumn("twice", put(F.col("once"))).collect():
        assert r["once"] == r["twice"] and "new" in r["once"] and "old" not in r["once"]


def test_caps_by_category_or_type(spark):
    from threadloom.operators import compress

    limits = {"terminal": 150, "build": 150, "test": 150, "tool_call": 150, "tool_result": 150, "file_edit": 150, "file_read": 160, "plan": 160, "user_message": 20, "assistant_message": 25, "reasoning": 6, "meta": 1}
    by_type = ("user_message", "assistant_message", "reasoning", "meta")
    rows = [(1, n * 100 + k, None if c in by_type else c, c if c in by_type else "tool_call", n > 158) for n in range(161) for k, c in enumerate(limits)]
    rows += [(1, 100000 + n, None, "error", False) for n in range(160)]
    kept = compress.head_per_category(spark.createDataFrame(rows, "session_id long, seq long, category string, type string, is_failure boolean")).collect()
    got = {c: sorted(r["seq"] for r in kept if (r["category"] or r["type"]) == c) for c in [*limits, "error"]}
    for k, (c, limit) in enumerate(limits.items()):
        assert got[c] == [n * 100 + k for n in range(161) if n < limit or n > 158]
    assert len(got["error"]) == 160


def test_null_keys_of_messages_are_equal(spark, tmp_path):
    long = "x" * 41
    rows = [(1, None, "web", long), (2, None, "web", long), (3, "en", None, long), (4, None, None, long), (5, "en", "web", long), (6, "en", "web", long), (7, None, None, "short"), (8, None, None, "short")]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own, want = compared(spark, str(tmp_path), QUERIES["w1_message_dedup"], ORACLE_SQL["w1_message_dedup"])
    assert own == want == (["doc_id"], [(1,), (3,), (4,), (5,), (7,), (8,)])


def test_short_passages_are_found(spark, tmp_path):
    texts = ["one two three four five six seven", "zone two three four fives", "one", "", None, " two  three"]
    passages = ["one two three four five", "one two three four five six", "two three four", "one two", "one", "e", "two  three", " two", "", None, "ne two three four five si"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own, want = compared(spark, str(tmp_path), QUERIES["j6_contains_join"], ORACLE_SQL["j6_contains_join"])
    assert own == want and (0, 0) in own[1] and (1, 0) in own[1]


@pytest.fixture
def no_broadcast(spark):
    """Joins as on large tables, where no side is small enough to be sent to all tasks."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_digests_without_broadcast(spark, no_broadcast):
    own, want = compared(spark, SF, QUERIES["c2_digest"], ORACLE_SQL["c2_digest"])
    assert own == want


@pytest.mark.parametrize("name", ["d1_memory_document", "g1_markdown", "d12_comparison", "d6_merged_documents", "k6_patches"])
def test_documents_without_broadcast(spark, no_broadcast, name):
    if name in ORACLE_SQL:
        own, want = compared(spark, SF, QUERIES[name], ORACLE_SQL[name])
        assert own == want
    else:
        rows = QUERIES[name](spark, SF).collect()
        want = {str(r["user_id"]) for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().collect()}
        assert {r["session_id"] for r in rows} == want and len(rows) == len(want) and all(r[1] for r in rows)
