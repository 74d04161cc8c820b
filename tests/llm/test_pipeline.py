"""The stages of the pipeline and run(), on small tables with nulls, repeats, clashing names and no rows, against plain Python."""

import random
import re

import pytest
import xxhash

import corpus_pipeline

#: Columns whose names the operators use themselves.
EXTRA = "lang string, source string, n_chars long, score double, held_out boolean, predicted int, spans string, base string, _id long, _hash long, _n int, _group string, _more int, component_id long, name string"
SCHEMA = f"doc_id long, text string, {EXTRA}"
STAGES = dict(corpus_pipeline.STAGES)
KEY = "Zk9fQ2xR7pLw3TnV8bYc1JdH5sGm4XaE"


def rows_of(texts):
    return [(i, t, "en", "web", len(t or ""), -1.0, None, 9, "s", "b", 5, 6, 7, "g", 8, 4, "n") for i, t in enumerate(texts)]


def prose(r, n=60):
    return " ".join(r.choice(["the", "river", "runs", "slowly", "home", "under", "old", "trees", "and", "falls"]) + r.choice(["", "", ",", "s"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = random.Random(11)
    good = [prose(r) for _ in range(150)]
    bad = [" ".join(r.choice(["BUY!!", "NOW!!", "***", "click%%"]) for _ in range(40)) for _ in range(150)]
    d = str(tmp_path_factory.mktemp("sf") / "t")
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(7, 0), (None, 1)], "doc_id long, quality int")
    labels.write.parquet(f"{d}/labels.parquet")
    texts = [*good, *bad, good[0], "  " + good[1].replace(" ", "  "), good[2] + f" password: {KEY}", None, None, "", good[3] * 200]
    rows = rows_of(texts)
    rows.append(rows[4])  # a repeated row
    rows.append((None, good[5], *rows[5][2:]))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{d}/documents.parquet")
    return d, docs, rows


def test_quality_keeps_the_good(spark, data):
    d, docs, rows = data
    out = STAGES["quality classifier"](spark, docs, d)
    assert out.columns == docs.columns
    kept = [tuple(x) for x in out.collect()]
    ids = [x[0] for x in kept]
    assert {i for i in range(150)} <= set(ids) and not {i for i in range(150, 300)} & set(ids)
    assert ids.count(4) == 2 and None in ids and set(kept) <= set(rows)


def test_exact(spark, data):
    d, docs, rows = data
    out = STAGES["exact dedup"](spark, docs, d)
    assert out.columns == docs.columns
    groups: dict = {}
    for x in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x[1] or ""), []).append(x)
    least = lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0)
    want = [min(g, key=least)[:2] for g in groups.values()]
    got = sorted(((x["doc_id"], x["text"]) for x in out.collect()), key=str)
    blank = lambda ps: sorted((p for p in ps if (p[1] or "").strip()), key=str)  # noqa: E731  (null and empty are one group)
    assert blank(got) == blank(want) and len(got) == len(want)


def fingerprint(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near(spark, data):
    d, docs, rows = data
    out = STAGES["simhash near-dedup"](spark, docs, d)
    assert out.columns == docs.columns
    fp = [fingerprint(x[1]) for x in rows]
    group = list(range(len(rows)))
    for _ in range(3):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if group[j] < group[i] and (fp[i] ^ fp[j]).bit_count() <= 4:
                    group[i] = group[j]
    least: dict = {}
    for x, g in zip(rows, group):
        least[g] = min(least.get(g, 10**9), x[0] if x[0] is not None else 10**9)
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(least.values())


def test_secrets(spark, data):
    d, docs, rows = data
    out = STAGES["secret scans"](spark, docs, d)
    assert out.columns == docs.columns and out.count() == len(rows)
    got = {x["doc_id"]: x for x in out.collect()}
    assert got[302]["text"] == rows[302][1].replace(f"password: {KEY}", "[SECRET]") and got[302]["n_chars"] == len(got[302]["text"])
    same = [i for i in range(303) if i != 302]
    assert all(got[i]["text"] == rows[i][1] and got[i]["n_chars"] == rows[i][4] for i in same) and got[303]["text"] is None
    assert got[0]["spans"] == "s" and got[0]["_more"] == 8


def test_packing(spark, data):
    d, docs, rows = data
    pieces = STAGES["packing"](spark, docs, d).collect()
    total: dict = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    whole = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert set(total) == {x[0] for x in rows} and whole[303] == 1 and total[4] == 2 * whole[4]
    assert all(total[i] == whole[i] for i in total if i != 4)


def test_no_rows(spark, data):
    d, docs, _ = data
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.filter("doc_id < -1"), d)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_run(spark, data):
    d, docs, rows = data
    docs_out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs_out, d)
    kept = sorted(x["doc_id"] if x["doc_id"] is not None else -1 for x in docs_out.select("doc_id").collect())
    packed = {p["doc_id"] if p["doc_id"] is not None else -1 for p in corpus_pipeline.run(spark, d).collect()}
    assert sorted(packed) == kept and not packed & {300, 1} and len(kept) >= 140
