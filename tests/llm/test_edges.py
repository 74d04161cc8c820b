"""Corners of the corpus operators: hot keys, caches that overflow, unbroken and very long texts, odd vectors, ties."""

import hashlib
import random

import numpy as np
import public_tokenizers
import xxhash

from threadloom.llm import bpe, chat, exact_dedup, packing, permutation_index, simhash

DOCS = "doc_id long, text string"


def test_keys_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST", 1)
    r = random.Random(1)
    texts = [r.choice(["hot " * 20, "hot " * 20, "warm " * 9 + "end", f"own {k} " * 5]) for k in range(150)]
    rows = {x["doc_id"]: x for x in exact_dedup.exact_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4), block=8).collect()}
    groups = {}
    for k, t in enumerate(texts):
        groups.setdefault("".join(t.split()), []).append(k)
    assert len(rows) == len(texts)
    for norm, ids in groups.items():
        for k in ids:
            assert (rows[k]["keep_id"], rows[k]["group_size"], rows[k]["kept"], rows[k]["text_sha256"]) == (min(ids), len(ids), k == min(ids), hashlib.sha256(norm.encode()).hexdigest())


def test_tokens_beyond_the_caches(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "KEPT", 7)
    monkeypatch.setattr(packing, "KEPT", 7)
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(60)]
    texts += ["x" * 50_000, "ab" * 30_000 + " ab", "".join(r.choice("abc0") for _ in range(40_000)), "͸ a͸b ͸͸", "don't" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        ids = library.encode(texts[x["doc_id"]], add_special_tokens=False).ids
        assert x["ids"] == ids and x["decoded"] == library.decode(ids, skip_special_tokens=False)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {}
    for p in packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), held=5000).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    for k, t in enumerate(texts):
        assert [i for _, ids in sorted(got[k]) for i in ids] == [*library.encode(t, add_special_tokens=False).ids, 1]


def test_fingerprint_of_many_shingles():
    words = [f"w{k * k % 70_001}" for k in range(70_000)]
    ones = np.zeros(64, int)
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42)
        ones += np.array([h >> b & 1 for b in range(63, -1, -1)])
    want = int("".join("1" if 2 * n > len(words) - 3 else "0" for n in ones), 2)
    assert int(simhash.fingerprints_of([" ".join(words)]).view(np.uint64)[0]) == want


def test_turns_of_one_place_and_no_role(spark):
    rows = [(1, 0, None, "b"), (1, 0, None, "a"), (1, 0, "assistant", "z"), (1, 0, "assistant", "y"), (1, None, "user", "first"), (1, 2, "assistant", "end")]
    turns = spark.createDataFrame([(*r, 9, "k") for r in rows], "conv_id long, turn long, role string, text string, example int, whole string").repartition(3)
    got = chat.conversation_digest(chat.prefix_target_examples(turns)).first()
    own = sorted(((-1 if t is None else t), role or "", text) for _, t, role, text in rows)
    assert got["n_turns"] == 6 and got["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(b for _, a, b in own if a == "assistant").encode()).hexdigest()


def test_odd_and_repeated_vectors(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(120, 8))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)]
    odd = [(200, [float("inf")] * 8), (220, [1.0] * 7), (240, []), (None, [1.0] * 8), (260, [float("-inf"), *[0.0] * 7])]
    df = spark.createDataFrame([*rows, *rows[:30], *odd], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in permutation_index.nearest_neighbours(df, exact=True).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert sorted(got) == list(range(0, 120, 20))
    for q, found in got.items():
        s = m @ m[q]
        s[q] = -np.inf
        assert [v for _, v in sorted(found)] == np.lexsort((np.arange(120), -s))[:20].tolist()
