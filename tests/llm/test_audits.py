"""The source audit, the conversation repair and the Jaccard join against brute force, on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import conversation_repair, count_min, jaccard_join, source_audit

DOCS = "doc_id long, text string, lang string, source string, name string, n int, block int, label int, v int, term string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "t") for r in rows], DOCS).repartition(3)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def test_sketch_never_underestimates(spark):
    values = [random.Random(1).randrange(300) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    own = lambda v: np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(5)
    sketch = count_min.merged_sketch(df, lambda b: [own(b.column("v").to_pylist())], bits=6, depth=3)
    found = count_min.counts_of(sketch, own(list(range(300))))
    true = Counter(values)
    assert all(f >= min(255, true[v]) for v, f in enumerate(found))
    assert not count_min.merged_sketch(df.filter("v < 0"), lambda b: [own(b.column("v").to_pylist())], bits=6, depth=3).any()


def test_sketch_tells_frequent_from_very_frequent(spark):
    """Where all counters are beyond 255, what is more frequent still comes out as more frequent."""
    df = spark.range(0, 6000, numPartitions=3).selectExpr("IF(id < 3000, -1L, id) AS v")
    own = lambda v: np.array(v, np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sketch = count_min.merged_sketch(df, lambda b: [own(b.column("v").to_pylist())], 3, 2, (1 << 32) - 1)
    frequent, *others = count_min.counts_of(sketch, own([-1, *range(3000, 3050)])).tolist()
    assert frequent >= 3000 and sketch.min() > 255 and sum(o < frequent for o in others) > 25


def test_texts_let_through_for_many_ids(spark):
    """Beyond a broadcast of ids, texts that aren't asked for stay out of the shuffle, and none asked for is lost."""
    docs = spark.range(0, 20_000).selectExpr("IF(id = 77, NULL, id) AS doc_id", "'t' AS text")
    wanted = docs.filter("doc_id % 10 = 3 OR doc_id IS NULL").selectExpr("doc_id AS doc_")
    left = jaccard_join.likely_rows(docs, wanted, wanted.count())
    assert left.columns == ["doc_id", "text"] and left.count() < 5000
    assert left.join(wanted, F.col("doc_id").eqNullSafe(F.col("doc_")), "left_semi").count() == 2001


def audit_by_hand(rows, least, top):
    def terms(t):
        return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))

    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        groups[lang or "", source or ""].update(terms(text))
        seen[lang or ""].update(set(terms(text)))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = {t for t, k in seen[lang].items() if k >= least}
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in own.items():
            pair = [(sum(abs(share(c, t) - share(d, t)) for t in kept), o) for o, d in own.items() if o != s]
            term = [(share(c, t) - share(whole, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top}
    return out


@pytest.mark.parametrize("held", [8, 1 << 18])
def test_audit(spark, held, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "BITS", 8)
    monkeypatch.setattr(source_audit, "AT_ONCE", 16)
    r = random.Random(held)
    words = ["alpha", "Beta", "ÉTÉ", "été", "x", "don't", "a1b", "ünï", " ", "zz" * 40, *[f"w{chr(97 + k)}" for k in range(20)]]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(100, None, "en", "silent"), (101, "", "none", "p"), (102, "only once", "none", "q"), (103, "...", "alone", "p"), *rows[:5], (None, "x " * 500, "en", "a")]
    found = source_audit.divergence_audit(docs_of(spark, rows), least=4, top=3).collect()
    assert {tuple(x) for x in found} == audit_by_hand(rows, 4, 3) and len(found) == len({tuple(x) for x in found})
    assert source_audit.divergence_audit(docs_of(spark, []), least=4).count() == 0


def repaired_by_hand(turns):
    """The cheapest edits of all that there are: cost, audit and repaired turns."""
    seen, options = set(), []
    for role, text in turns:
        said = text.strip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
        seen.add((role, text))
        more = 3 if fault == "truncated" else 0
        keep = [] if fault in ("blank", "duplicate") else [("K", more, [(role, text)]), *[("R", 3 + more, [(x, text)]) for x in ("user", "assistant")]]
        options.append([("D", 4, []), *keep])
    best = None
    adds = [("", []), *[("I" * len(x), [(y, "") for y in x]) for k in (1, 2) for x in itertools.product(("user", "assistant"), repeat=k)]]
    for picks in itertools.product(*options):
        for extra in itertools.product(adds, repeat=len(picks) + 1):
            if sum(len(x[0]) for x in extra) > 4:
                continue
            steps = [s for e, p in itertools.zip_longest(extra, picks) for s in ([(e[0], 3 * len(e[0]), e[1])] + ([p] if p else []))]
            out = [t for s in steps for t in s[2]]
            if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "?" for role, _ in out)):
                own = (sum(s[1] for s in steps), "".join(s[0] for s in steps), out)
                best = own if best is None or own[:2] < best[:2] else best
    return best


def test_cheapest_edits():
    r = random.Random(2)
    for _ in range(150):
        turns = [(r.choice(["system", "user", "assistant", "tool", "user", "assistant"]), r.choice(["a.", "b", "c!", "", "d?"])) for _ in range(r.randint(0, 4))]
        seen, faults = set(), []
        for t in turns:
            faults.append("blank" if not t[1] else "duplicate" if t in seen else "truncated" if t[1][-1] not in ".!?" else None)
            seen.add(t)
        cost, edits = conversation_repair.cheapest_edits([t[0][:1] for t in turns], faults)
        edits = list(edits)
        want = repaired_by_hand(turns)
        assert (cost, "".join(x for x, _ in edits)) == want[:2]
        assert "".join(x for _, x in edits) == "".join(role[0] for role, _ in want[2])


def test_repair(spark):
    r = random.Random(4)
    rows = [(k % 40 if k % 40 else None, r.choice([None, *range(6)]), r.choice(["system", "user", "assistant", "", None, "Tool"]), r.choice(["Ja.", "no", "", None, " \n", "Ende?  ", "x. "])) for k in range(130)]
    rows += [(50, t, "user", "same.") for t in (1, 1, 4)] + rows[:3]
    df = spark.createDataFrame([(*x, 1, "k", 7) for x in rows], "conv_id long, turn long, role string, text string, pos int, letters string, cost long").repartition(3)
    found = {x["conv_id"]: x for x in conversation_repair.repair_audit(conversation_repair.damage(df), df).collect()}
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    assert set(found) == set(damaged)
    for conv, turns in damaged.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        places = {t for t, _, _ in turns if t is not None}
        row = found[conv]
        assert row["gaps"] == (max(places) - min(places) + 1 - len(places) if places else 0)
        assert row["illegal"] == sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        if len(turns) <= 4:
            cost, audit, out = repaired_by_hand([t[1:] for t in turns])
            assert (row["cost"], row["audit"], row["repaired_sha256"]) == (cost, audit, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest())
    assert conversation_repair.repair_audit(df.limit(0)).count() == 0


def test_long_conversation(spark):
    turns = spark.range(30000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    row = conversation_repair.repair_audit(turns).first()
    assert (row["cost"], row["illegal"], row["audit"]) == (0, 0, "K" * 30000)


def sets_by_hand(texts, words):
    out = []
    for t in texts:
        found = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        out.append({tuple(found[k : k + words]) for k in range(len(found) - words + 1)} or ({tuple(found)} if found else set()))
    return out


def groups_by_hand(texts, words, percent):
    sets = sets_by_hand(texts, words)
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            old, new = max(group[a], group[b]), min(group[a], group[b])
            group = [new if g == old else g for g in group]
    return [(len(s), g) for s, g in zip(sets, group)]


@pytest.fixture(scope="module")
def near_texts():
    r = random.Random(8)
    word = lambda: f"w{r.randrange(400)}"
    base = [[word() for _ in range(r.choice([3, 8, 25, 60, 200]))] for _ in range(15)]
    rows = list(base)
    for b in base[5:]:
        for _ in range(8):  # chains of changes as well as copies of one text
            own = list(r.choice(rows[-3:]) if r.random() < 0.5 and len(rows[-1]) == len(b) else b)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            rows.append(own + [word() for _ in range(r.randint(0, len(own) // 10))])
    common = [word() for _ in range(40)]
    rows += [common + [word() for _ in range(r.randint(0, 12))] for _ in range(20)]
    texts = [" ".join(x) for x in rows]
    return [*texts, *texts[:6], None, "", " \n\t ", "A b", "a B", "É é", "é é", texts[7].upper() + " x", "q" * 9000, texts[3] + "\v" + texts[3]]


@pytest.mark.parametrize("rows, entries, at_once", [(1024, 1 << 21, 1 << 22), (6, 1 << 21, 40), (1024, 300, 1 << 22)])
def test_jaccard(spark, near_texts, rows, entries, at_once, monkeypatch):
    for name, value in (("ROWS", rows), ("ENTRIES", entries), ("AT_ONCE", at_once), ("COLUMNS", 64), ("BITS", 10), ("BROADCAST_IDS", rows)):
        monkeypatch.setattr(jaccard_join, name, value)
    for words, percent in ((4, 85), (5, 80))[: 2 if rows == 6 else 1]:
        docs = docs_of(spark, [(k, t, None, None) for k, t in enumerate(near_texts)])
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs, words, percent).collect()}
        assert [found[k] for k in range(len(near_texts))] == groups_by_hand(near_texts, words, percent)


def test_jaccard_of_odd_rows(spark):
    docs = docs_of(spark, [(None, "one two three four five", None, None), (4, "one two three four five", None, None), (4, "one two three four five", None, None), (None, "alone", None, None), (4, "another", None, None), (None, None, None, None)])
    found = sorted(map(tuple, jaccard_join.jaccard_groups(docs, 4, 85).collect()), key=str)
    assert found == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None), (4, 1, 4), (None, 0, None)], key=str)
    assert jaccard_join.jaccard_groups(docs.limit(0)).count() == 0


def test_products_in_tiles():
    r = random.Random(5)
    for _ in range(20):
        sets = [np.unique(np.array([r.randrange(60) for _ in range(r.choice([5, 40, 50]))], np.uint64)) for _ in range(12)]
        i, j = jaccard_join.linked_pairs(sets, None, 60)
        linked = lambda x, y: 100 * len(set(x) & set(y)) >= 60 * len(set(x) | set(y))
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in itertools.combinations(range(12), 2) if linked(sets[a], sets[b])}
        i, j = jaccard_join.linked_pairs(sets[:5], sets[5:], 60)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(5) for b in range(7) if linked(sets[a], sets[5 + b])}
