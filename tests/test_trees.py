"""Document trees: the token fold against a recursive reading, and trees deeper than any stack."""

import json
import random

import pytest
from pyspark.sql import functions as F

from threadloom.sources.bubble_kv import prose, tree_text


def recursive(tree):
    if not isinstance(tree, dict):
        return ""
    own = tree["text"] if tree.get("type") == "text" and isinstance(tree.get("text"), str) else ""
    content = tree.get("content")
    whole = own + "".join(map(recursive, content if isinstance(content, list) else []))
    return whole + "\n" if whole and tree.get("type") == "paragraph" else whole


def made(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice([None, True, -1.5e3, "s \" \\ \n é", [], {}, {"type": "text", "text": "leaf"}, {"type": "text", "text": 5}, ["a", {"type": "text", "text": "no"}]])
    node = {"type": r.choice(["paragraph", "text", "doc", 3, None])}
    for key in r.sample(["content", "text", "attrs", "marks", "x"], r.randint(0, 5)):
        node[key] = [made(r, depth - 1) for _ in range(r.randint(0, 3))] if key in ("content", "marks") else r.choice([lambda: made(r, depth - 1), lambda: "words", lambda: 1])()
    return dict(r.sample(sorted(node.items()), len(node)))


def test_fold_reads_as_recursion_does():
    r = random.Random(3)
    for _ in range(3000):
        tree = made(r, r.randint(0, 6))
        text = json.dumps(tree, indent=r.choice([None, 1]), ensure_ascii=r.random() < 0.5)
        assert tree_text(text) == recursive(json.loads(text))
        at = r.randrange(len(text) + 1)
        broken = text[:at] + r.choice(["", "}", ",", '"', "x", ":", "]", "0", "[", "tru"]) + text[at + r.randint(0, 1) :]
        try:
            want = recursive(json.loads(broken))
        except ValueError:
            want = ""
        assert tree_text(broken) == want


@pytest.mark.parametrize("text, want", [('{"type":"text","text":"a","text":"b"}', "b"), ('{"content":[{"type":"text","text":"a"}],"content":[]}', ""), ('{"type":"text","text":"a","type":{"type":"x"}}', ""), ("", ""), ("[", ""), ('{"a":1}}', ""), ('{"type":"text","text":"\\ud83d\\ude00"}', "\U0001f600")])
def test_odd_trees(text, want):
    assert tree_text(text) == want


def test_any_depth(spark):
    depth = 100_000
    deep = '{"type":"doc","content":[' * depth + '{"type":"paragraph","content":[{"type":"text","text":"here"}]}' + "]}" * depth
    df = spark.createDataFrame([(deep,), ('{"type":"text","text":"x"}',), (None,)], "t string")
    assert [r[0] for r in df.select(prose(F.col("t"))).collect()] == ["here\n", "x", ""]
