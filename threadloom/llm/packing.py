"""Sequence packing by minimum bin slack.

Each task packs the documents of its own partition, so nothing is shuffled.  A document becomes full windows and one
remaining piece; the remaining pieces of a stretch of documents form a multiset of lengths.  For each window the
largest piece is placed first and a subset-sum dynamic program over the others, with reachable fills as the bits of an
integer, finds the multiset that leaves the least slack; going back through the recorded bitsets gives the count of
each length, and the pattern is used as often as those counts allow.  If slack remains, one more piece is cut to fill
it.  What is left at a partition's end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, small_batches

CAPACITY = 2048
END_ID = 1
#: Tokens whose pieces are held at once, and distinct chunks and pieces of text whose ids a task keeps.
HELD = 1_000_000
KEPT = 600_000


#: Texts of these characters alone are split here as the vocabulary's own pre-tokenizer splits them.
PLAIN = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+"
END_OF_WORD = "</w>"


@functools.lru_cache(maxsize=1)
def encoder(vocabulary: str):
    """A function from a list of texts to a list of bytes: their ids as little-endian 32-bit integers.

    The vocabulary is lower case, drops white space and merges nothing across the pieces that it splits a text into.
    So pieces are encoded once each, many in one string, and are told apart by the tokens that end a word.  A text
    with other characters, or with a control string, is encoded as a whole.  A worker keeps it for its next task,
    with the pieces that it knows.
    """
    import gc
    import json
    import os
    import re

    import numpy as np

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(vocabulary)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in spec["model"]["vocab"].items():
        ends[i] = token.endswith(END_OF_WORD)
    control = [x["content"] for x in spec["added_tokens"]]
    odd, pieces = re.compile(PLAIN).search, re.compile(PIECES).findall
    known: dict[str, bytes] = {}
    chunks: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(new: list[str]) -> None:
        for at in range(0, len(new), 2000):
            some = new[at : at + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(cuts) == len(some):
                data = ids.tobytes()
                known.update(zip(some, [data[4 * a : 4 * z] for a, z in zip([0, *cuts], cuts)]))
            else:
                known.update(zip(some, whole(some)))

    def encode(texts: list[str]) -> list[bytes]:
        gc.disable()  # nothing here forms cycles, and many small lists would set it off again and again
        if len(known) > KEPT:
            known.clear()
        if len(chunks) > KEPT:
            chunks.clear()
        parts: list = [None if odd(t) or any(c in t for c in control) else t.lower().split() for t in texts]
        cut = {c: pieces(c) for c in set().union(*[p for p in parts if p]) if c not in chunks}
        learn([p for p in set().union(*cut.values()) if p not in known])
        get = known.__getitem__
        for c, p in cut.items():
            chunks[c] = known[p[0]] if len(p) == 1 else known[p[0]] + known[p[1]] if len(p) == 2 else b"".join(map(get, p))
        get = chunks.__getitem__
        out = [b"".join(map(get, p)) if p is not None else whole([t.encode("utf-8", "replace").decode()])[0] for t, p in zip(texts, parts)]
        gc.enable()
        return out

    return encode


def least_slack(counts: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts[length], whose sum is closest to room from below."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        have = min(counts[length], room // length)
        if not have:
            continue
        steps.append((length, have, reach))
        block = 1
        while have > 0:  # binary splitting: every count from 0 to have is a sum of blocks
            block = min(block, have)
            reach |= (reach << (block * length)) & mask
            have -= block
            block *= 2
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, {}
    for length, have, before in reversed(steps):
        n = 0
        while not before >> fill & 1:
            fill -= length
            n += 1
        assert n <= have
        if n:
            chosen[length] = n
    return chosen


class Packer:
    """Places pieces (doc_id, start, ids, doc_tokens) into sequences; yields rows through `rows`."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.capacity, self.next_id = capacity, first_id
        self.stacks: list[list[tuple]] = [[] for _ in range(capacity)]
        self.counts = [0] * capacity
        self.held = 0
        self.rows: list[tuple] = []

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.stacks[n].append(piece)
        self.counts[n] += 1
        self.held += n

    def take(self, length: int) -> tuple:
        self.counts[length] -= 1
        self.held -= length
        return self.stacks[length].pop()

    def add(self, doc_id, ids: bytes) -> None:
        total, width = len(ids) // 4, self.capacity * 4
        at = 0
        while len(ids) - at >= width:
            self.emit([(doc_id, at // 4, ids[at : at + width], total)])
            at += width
        if at < len(ids):
            self.put((doc_id, at // 4, ids[at:], total))

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def largest(self) -> int:
        return next(n for n in range(self.capacity - 1, 0, -1) if self.counts[n])

    def pack(self, down_to: int) -> None:
        """Fill whole sequences until at most down_to tokens are held."""
        while self.held > max(down_to, self.capacity - 1):
            first = self.largest()
            self.counts[first] -= 1
            chosen = least_slack(self.counts, self.capacity - first)
            self.counts[first] += 1
            chosen[first] = chosen.get(first, 0) + 1
            slack = self.capacity - sum(n * k for n, k in chosen.items())
            times = 1 if slack else min(self.counts[n] // k for n, k in chosen.items())
            for _ in range(max(1, min(times, self.held // self.capacity))):
                pieces = [self.take(n) for n, k in chosen.items() for _ in range(k)]
                if slack:
                    doc_id, start, ids, total = self.take(self.largest())
                    pieces.append((doc_id, start, ids[: slack * 4], total))
                    self.put((doc_id, start + slack, ids[slack * 4 :], total))
                self.emit(pieces)

    def finish(self) -> None:
        self.pack(0)
        rest = [self.take(n) for n in range(self.capacity - 1, 0, -1) for _ in range(self.counts[n])]
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            room, pieces = size, []
            while room:
                doc_id, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: n * 4], total))
                if n * 4 < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[n * 4 :], total))
                room -= n
            self.emit(pieces)
            left -= size


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, held: int = HELD) -> DataFrame:
    """Per piece of docs(doc_id, text): doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the piece's token ids as little-endian unsigned 32-bit integers.  A document is its text's ids and END_ID;
    a null or empty text is END_ID alone, and a text of any length is cut into as many pieces as it takes.  Every id lies in one piece, and the pieces of a sequence fill it without a
    gap: to capacity, or to a power of two below it at a partition's end.  Repeated rows are packed as often as they
    occur.  Other columns are ignored.  An empty table gives no piece.  The result depends on how docs is partitioned.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema(
        [("doc_id", to_arrow_type(kind)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
        + [(n, pa.int64()) for n in ("doc_tokens", "sequence_id", "offset")]
    )

    def out(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows))
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    packer.add(doc_id, ids + end)
                    if packer.held > held:
                        packer.pack(held // 2)
                    if len(packer.rows) > 2000:
                        yield out(packer)
        packer.finish()
        if packer.rows:
            yield out(packer)

    return docs.select("doc_id", plain_text().alias("text")).mapInArrow(run, schema)


def packing_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
