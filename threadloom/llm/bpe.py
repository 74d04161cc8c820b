"""Byte-level BPE encoding and decoding with forced boundaries.

A merge only ever makes a token of the vocabulary.  A pair of neighbouring bytes that stands inside no token can't be
joined by any merge, so a cut between them is certain.  The words of the pre-tokenizer are cut at all such pairs, each
distinct fragment is encoded once and on its own, and the ids are concatenated.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, small_batches

#: Distinct words whose ids a task keeps.
KEPT = 400_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def unassigned() -> str:
    """A character class of the code points that Unicode versions may classify differently."""
    ranges: list[list[int]] = []
    for cp in range(0x110000):
        if unicodedata.category(chr(cp)) == "Cn":
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


class ForcedBoundaryBpe:
    """Encodes and decodes texts with the vocabulary file of a byte-level BPE (its contents, not its path)."""

    def __init__(self, vocabulary: str, odd: str | None = None):
        import os

        import numpy as np
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level vocabulary")
        self.letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(self.letters)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.inside = np.zeros(65536, np.uint8)
        for token in self.bytes_of.values():
            for pair in zip(token, token[1:]):
                self.inside[pair[0] << 8 | pair[1]] = 1
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.size = np.array([len(t) for t in tokens])
        self.start = np.cumsum(self.size) - self.size
        self.table = np.frombuffer(b"".join(tokens), np.uint8)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.odd = re.compile(odd or unassigned()).fullmatch
        self.even: set[str] = set()
        self.pre = Tokenizer.from_str(vocabulary).pre_tokenizer
        self.byte_of = byte_of
        self.fragments = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "added_tokens": [], "decoder": None}))
        self.kept: dict[str, bytes] = {}

    def has_odd(self, text: str) -> bool:
        """Whether the text has an unassigned code point; each character is looked at once, then known."""
        fresh = set(text) - self.even
        odd = {c for c in fresh if self.odd(c)}
        self.even |= fresh - odd
        return bool(odd)

    def words_of(self, text: str) -> list[str]:
        if text.isascii() or not self.has_odd(text):
            return self.words(text)
        return [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.pre.pre_tokenize_str(text)]

    def learn(self, words: list[str]) -> None:
        """Cut the words at all certain boundaries, encode each distinct fragment, and keep the words' ids."""
        import numpy as np

        parts = [w.encode("utf-8") for w in words]
        data = b"".join(parts)
        d = np.frombuffer(data, np.uint8).astype(np.int32)
        ends = np.cumsum([len(p) for p in parts])
        forced = self.inside[d[:-1] << 8 | d[1:]] == 0
        forced[ends[:-1] - 1] = True
        stops = np.r_[np.flatnonzero(forced) + 1, len(data)]
        upto = np.searchsorted(stops, ends, "right").tolist()
        stops = stops.tolist()
        fragments = [data[a:z] for a, z in zip([0, *stops], stops)]
        distinct, letters = list(set(fragments)), self.letters
        encoded = self.fragments.encode_batch_fast(["".join([letters[b] for b in f]) for f in distinct], add_special_tokens=False)
        ids = {f: np.array(e.ids, "<i4").tobytes() for f, e in zip(distinct, encoded)}
        self.kept.update({w: b"".join([ids[f] for f in fragments[a:z]]) for w, a, z in zip(words, [0, *upto], upto)})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if len(self.kept) > KEPT:
            self.kept.clear()
        parts = []
        for text in texts:
            pieces = self.split.split(text) if self.split and any(s in text for s in self.added) else [text]
            parts.append([(p in self.added, p if p in self.added else self.words_of(p)) for p in pieces if p])
        new = list({w for part in parts for special, words in part if not special for w in words if w not in self.kept})
        for at in range(0, len(new), 10_000):
            self.learn(new[at : at + 10_000])
        kept = self.kept
        return [
            b"".join([self.added[words].to_bytes(4, "little") if special else b"".join([kept[w] for w in words]) for special, words in part])
            for part in parts
        ]

    def decode(self, ids: bytes) -> str:
        import numpy as np

        token = np.frombuffer(ids, "<i4")
        size = self.size[token]
        ends = np.cumsum(size)
        if not len(token) or not ends[-1]:
            return ""
        at = np.arange(ends[-1]) + np.repeat(self.start[token] - ends + size, size)
        return self.table[at].tobytes().decode("utf-8", "replace")


def encode_decode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, ids (array of int), decoded.

    ids are what the tokenizers library gives for the whole text, control strings of the vocabulary included, without
    special tokens added; decoded is made from the ids.  Texts of any length are encoded whole.  Null and empty texts give no ids and an empty text.  Repeated
    rows stay, other columns are ignored, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast((f.read(), unassigned()))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = ForcedBoundaryBpe(*shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = bpe.encode(part.column(1).to_pylist())
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                offsets = pa.array(np.cumsum([0, *(len(i) // 4 for i in ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, values), pa.array([bpe.decode(i) for i in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, ids array<int>, decoded string")


def encoding_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
