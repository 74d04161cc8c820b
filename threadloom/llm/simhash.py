"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2 r bits have a word halfway between them, within r bits of both.  So every
distinct fingerprint yields all its variants within r = 2 flipped bits, variants meet by equality, and the owners of
one variant are linked.  All owners of a variant are within 2 r bits of each other, so a star from one of them links
them as all pairs would; the pairs of the star are verified.

A variant is shuffled in blocks: a fingerprint goes once to each prefix that any of its variants has, and the variants
of that prefix are made there.  A prefix that gathers many fingerprints, as a large group of near copies does, is
split further by parity bits of the variant, which spread the ball around any fingerprint evenly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save, small_batches
from .components import components

WORDS = 4
#: Bits flipped on either side; fingerprints link at twice as many.
RADIUS = 2
#: Fingerprints per prefix on average, and those from which a prefix is split; variants sorted at once.
PER_PREFIX = 4096
SPLIT_FROM = 1 << 17
AT_ONCE = 1 << 20


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 (seed 42) of each shingle of the text in ASCII lower case; of the whole if it has fewer words."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    line, ends, at = b" ".join(found), [], -1
    for w in found:
        at += 1 + len(w)
        ends.append(at)
    first = [0, *[e + 1 for e in ends]]
    last = ends[words - 1 :] or ends[-1:]
    return list(map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(first, last)], repeat(42)))


def fingerprints_of(texts: list[str], words: int = WORDS):
    """The 64-bit fingerprints of texts, as an array of int64: a bit is set if over half the hashes have it."""
    import numpy as np

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        hashes = shingle_hashes(text, words)
        ones, n = np.zeros(64, np.int64), len(hashes)
        for at in range(0, n, 1 << 16):
            bits = np.unpackbits(np.array(hashes[at : at + (1 << 16)], ">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int32)
        if n:
            out[k] = np.packbits(2 * ones > n).view(">u8")[0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, the columns of `keep`, fp (long).  Texts without words have 0."""
    small_batches(docs.sparkSession)
    columns = ["doc_id", *keep]
    schema = T.StructType([docs.schema[c] for c in columns]).add("fp", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = fingerprints_of([t or "" for t in part.column("text").to_pylist()], words)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array(fp)], names=[*columns, "fp"])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def flips(bits: int, most: int) -> list[int]:
    """The words of so many bits with at most so many set."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k)]


class Ball:
    """Links fingerprints that own a common variant among those with one prefix and one value of some parity bits."""

    def __init__(self, prefix_bits: int, radius: int = RADIUS):
        import numpy as np

        self.b, self.radius = prefix_bits, radius
        masks = np.array(flips(64, radius), np.uint64)
        code = [((i + 1) * 0x9E3779B97F4A7C15 >> 20 ^ (i + 7) * 0xC2B2AE3D27D4EB4F >> 31) & 0xFFFF for i in range(64)]
        self.table = np.zeros((8, 256), np.uint16)  # parity codes by byte
        for i in range(64):
            hit = np.arange(256) >> (i % 8) & 1 == 1
            self.table[i // 8, hit] ^= np.uint16(code[i])
        self.masks, self.mask_code, self.mask_top = masks, self.parity(masks), masks >> np.uint64(64 - prefix_bits)

    def parity(self, words):
        import numpy as np

        out = np.zeros(len(words), np.uint16)
        for k, byte in enumerate(np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8).T):
            out ^= self.table[k, byte]
        return out

    def links(self, fps, prefix: int, part: int, part_bits: int):
        """Pairs (fingerprint, smaller label) of what meets; fps are distinct, as uint64 and sorted as int64."""
        import numpy as np

        top = fps >> np.uint64(64 - self.b) ^ np.uint64(prefix)
        kinds, of = np.unique(top, return_inverse=True)
        own = [np.flatnonzero(self.mask_top == k) for k in kinds]
        total = sum(len(o) * n for o, n in zip(own, np.bincount(of, minlength=len(kinds)))) >> part_bits
        more = max(0, math.ceil(math.log2(max(1, total / AT_ONCE))))
        bits = min(16, part_bits + more)
        low = np.uint16((1 << bits) - 1)
        code, label = self.parity(fps) & low, np.arange(len(fps))
        for sub in range(1 << (bits - part_bits)):
            wanted = np.uint16(sub << part_bits | part)
            need = (code ^ wanted).astype(np.int64)
            order = np.argsort(of * (1 << 16) + need, kind="stable")
            key = (of * (1 << 16) + need)[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            variants, owners = [], []
            for a, z in zip(starts, [*starts[1:], len(key)]):
                mine = own[key[a] >> 16]
                mine = mine[(self.mask_code[mine] & low) == (key[a] & 0xFFFF)]
                if len(mine):
                    who = order[a:z]
                    variants.append((fps[who][:, None] ^ self.masks[mine][None, :]).ravel())
                    owners.append(np.repeat(who, len(mine)))
            if variants:
                self.meet(fps, np.concatenate(variants), np.concatenate(owners), label)
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return fps[moved], fps[label[moved]]

    def meet(self, fps, variants, owners, label) -> None:
        """Lower the labels of fingerprints that share a variant to the smallest one, in place.

        Labels are roots before and after.  Only roots are lowered, so what earlier calls joined moves along.
        """
        import numpy as np

        order = np.argsort(variants)
        same = variants[order[1:]] == variants[order[:-1]]
        hit = np.r_[same, False] | np.r_[False, same]
        if not hit.any():
            return
        order = order[hit]
        owner, variant = owners[order], variants[order]
        starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        sizes = np.diff(np.r_[starts, len(owner)])
        centre = np.repeat(owner[starts], sizes)
        apart = np.bitwise_count(fps[owner] ^ fps[centre])
        keep = apart <= 2 * self.radius
        edges = np.unique(np.stack([owner[keep], centre[keep]], 1), axis=0)
        a, c = edges[edges[:, 0] != edges[:, 1]].T
        while True:
            u, v = label[a], label[c]
            if (u == v).all():
                return
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
            while (label != label[label]).any():
                label[:] = label[label]


def near_links(distinct: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """distinct(fp) to star edges u, v that connect what is within twice the radius, directly or through others."""
    bits = min(20, max(6, math.ceil(math.log2(max(1, count) / PER_PREFIX)))) if count else 6
    masks = F.array(*[F.lit(m).cast("long") for m in flips(bits, radius)])
    dealt = distinct.select(
        "fp", F.explode(F.transform(masks, lambda m: F.shiftrightunsigned(F.col("fp"), 64 - bits).bitwiseXOR(m))).alias("prefix")
    )
    heavy = dealt.groupBy("prefix").count().filter(F.col("count") > SPLIT_FROM).select(
        "prefix", F.least(F.lit(12), F.ceil(F.log2(F.col("count") / SPLIT_FROM))).cast("int").alias("part_bits")
    )
    groups = (
        dealt.join(heavy, "prefix", "left")
        .withColumn("part_bits", F.coalesce("part_bits", F.lit(0)))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("part_bits")).cast("int") - 1)))
    )

    def run(group: pa.Table) -> pa.Table:
        import numpy as np

        ball = Ball(bits, radius)
        fps = np.sort(group.column("fp").to_numpy())
        prefix, part, part_bits = (group.column(c)[0].as_py() for c in ("prefix", "part", "part_bits"))
        u, v = ball.links(fps.view(np.uint64), prefix, part, part_bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return groups.groupBy("prefix", "part").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, fingerprint, component_id, and the columns of `keep`.

    Texts are compared in ASCII lower case by shingles of `words` words; component_id is the smallest doc_id of all
    that are reachable over links of at most 2 * radius differing bits.  Null, empty and blank texts have fingerprint
    zero and link like any others; of a long text every shingle counts.  Equal texts, repeated rows and rows with a null doc_id stay, each with its
    component (the smallest doc_id that isn't null).  Other columns are ignored.  An empty table gives an empty result.
    """
    rows = save(fingerprints(docs, words, keep), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(near_links(distinct.select("fp"), rows.count(), radius))
    named = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    named = save(named, "named")
    least = save(named.groupBy("component").agg(F.min("first").alias("component_id")), "components")
    named = save(named.join(least, "component").select("fp", "component_id"), "named")  # joins of tables are split where a key is frequent
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep
    )
