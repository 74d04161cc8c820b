"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself.

Rows are the distinct shingle sets, columns are shingles.  The product is wanted only where a pair of rows can reach the
similarity, and bounds that follow from the sizes of sets say where that is:

* Columns have one order for all rows: rare ones first, as far as a sketch of the columns' counts can tell.  Two linked
  rows of n and m shingles have at least k(n) columns in common among the first n - ceil(t n) + k(n) of either.  Only
  these entries are shuffled.
* Rows that share fewer than k(n) of those columns with any others drop out, again and again; of the rest only the
  columns count that are left without the k(n) - 1 most frequent ones.  What still hangs together is a block of the
  product's diagonal; all other entries of the product are below the bound.
* A block is multiplied in tiles of at most ROWS rows a side, column block by column block.  Overlap counts accumulate,
  and pairs whose count plus the shingles that are left can't reach the bound are discarded between column blocks.
* A large block is first compared with a few typical rows; rows linked to the same one need no product with each other.
  Its other rows are dealt out by size, and bands too far apart in size never meet.

Shingles are named by 64 bits made of XXH64 of their words, sets by 128 bits of their shingles.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save, small_batches
from .components import components
from .count_min import counts_of, merged_sketch

WORDS = 5
PERCENT = 80
#: Of a sketch of the columns' counts: least and most bits, and its rows.  It has four counters a document within these.
BITS, MOST_BITS, DEPTH = 20, 22, 2
#: One in so many of a row's columns is looked at besides those that the bound needs.
SPARE = 20
#: Rows and shingles of a tile's side, columns multiplied at once, and typical rows that a large block is compared with.
ROWS = 1024
ENTRIES = 1 << 21
COLUMNS = 2048
CENTRES = 3
#: Rows whose texts are found by a broadcast of their ids; more are found by a shuffle of the texts that a bitmap of
#: hashed ids lets through, with so many bits for each id.
BROADCAST_IDS = 1 << 18
BITS_PER_ID, BITS_PER_BITMAP = 16, 1 << 15
#: Bytes of a text whose words are listed at once.
AT_ONCE = 1 << 22


def shingle_names(text: str, words: int):
    """The distinct shingles of a text in ASCII lower case as sorted uint64; fewer words are one shingle, none are none."""
    import numpy as np
    import xxhash

    data, at, parts, few = text.encode("utf-8", "surrogatepass").lower(), 0, [], []
    gap = re.compile(rb"[\x20\x09-\x0D]")
    while at < len(data):
        cut = gap.search(data, at + AT_ONCE)
        end = cut.start() if cut else len(data)
        found = (data[at:end] if at or cut else data).split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))
        few += found[: max(0, words - len(few))]
        at = end + 1
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes
    if len(hashes) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(few), seed=1)], np.uint64)
    mix, last = np.uint64(0x9E3779B97F4A7C15), len(hashes) - words + 1
    out = hashes[:last].copy()
    for k in range(1, words):
        out *= mix
        out += hashes[k : k + last]
    out ^= out >> np.uint64(32)
    out *= mix
    out ^= out >> np.uint64(29)
    return np.unique(out)


def spare(n):
    """k(n): columns that two linked rows have in common at least among those looked at."""
    return max(1, n // SPARE)


def looked_at(n: int, percent: int) -> int:
    return min(n, n + (-percent * n) // 100 + spare(n))


def least_shared(n: Column) -> Column:
    """k(n) less one for rounding, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n / SPARE) - 1).cast("int")


def batches_of_texts(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        yield part, [t or "" for t in part.column("text").to_pylist()]


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, name (of its set), n, and the columns that are looked at."""
    import numpy as np

    def hashes(batch: pa.RecordBatch) -> Iterator:
        for _, texts in batches_of_texts(batch):
            yield np.concatenate([shingle_names(t, words) for t in texts])

    texts = docs.select("doc_id", "text")
    bits = min(MOST_BITS, max(BITS, (4 * docs.count() - 1).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(texts.select("text"), hashes, bits, DEPTH, (1 << 32) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in batches_of_texts(batch):
                names, sizes, first = [], [], []
                for text in found:
                    own = shingle_names(text, words)
                    frequent = counts_of(sketch.value, own)
                    order = np.lexsort((own, frequent))[: looked_at(len(own), percent)]
                    names.append(set_name(own))
                    sizes.append(len(own))
                    first.append(own[order].view(np.int64))
                ends = pa.array(np.cumsum([0, *map(len, first)]), pa.int32())
                columns = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(first)))
                arrays = [part.column("doc_id"), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "name", "n", "columns"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, name binary, n long, columns array<long>")


def set_name(own) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def possible_rows(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets(row, n, columns) to the entries (row, column) that a pair within the bounds can share, and `typical`.

    Besides, the table that they are read from.

    typical is larger for rows whose columns are frequent.  Each round counts the columns among the rows that are left; more
    rounds leave fewer rows, and none loses a row with a partner.
    """
    entries = sets.select("row", F.col("n").cast("int").alias("n"), F.explode("columns").alias("column"))
    need, before, last = least_shared(F.col("n")), -1, []
    while True:
        often = save(entries.groupBy("column").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
        listed = entries.join(often, "column").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("often", "column"))).alias("own"), (F.sum(F.log2("often")) / F.first("n")).alias("typical"))
        listed = save(listed.filter(F.size("own") >= need), "rows")
        discard(often, *last)
        rows, last = listed.count(), [listed]
        if rows == 0 or 0 <= before <= 1.05 * rows:
            break
        before, entries = rows, listed.select("row", "n", F.explode("own.column").alias("column"))
    kept = F.slice("own.column", 1, F.size("own") - need + 1)
    return listed.select("row", "typical", F.explode(kept).alias("column")), listed


def blocks(entries: DataFrame) -> DataFrame:
    """entries(row, typical, column) to row, typical, block: rows that hang together over columns."""
    least = save(entries.groupBy("column").agg(F.min("row").alias("v")), "least")
    edges = entries.join(least, "column").select(F.col("row").alias("u"), "v").distinct()
    found = components(edges).select(F.col("node").alias("row"), F.col("component").alias("block"))
    return entries.select("row", "typical").distinct().join(found, "row")


def likely_rows(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The rows of docs(doc_id, ...) whose doc_id is in wanted(doc_), n rows, and about one in BITS_PER_ID of the others."""
    bitmaps = math.ceil(n * BITS_PER_ID / BITS_PER_BITMAP)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bitmaps * BITS_PER_BITMAP))
    marks = wanted.select(place("doc_").alias("at")).groupBy(F.floor(F.col("at") / BITS_PER_BITMAP).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITS_PER_BITMAP).alias("bitmap"))
    marks = save(marks, "marks")
    at = place("doc_id")
    placed = docs.withColumns({"bucket": F.floor(at / BITS_PER_BITMAP), "bit": (at % BITS_PER_BITMAP).cast("int")})
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return placed.join(F.broadcast(marks), "bucket").filter(F.getbit(byte, F.col("bit") % 8) == 1).drop("bucket", "bit", "bitmap")


def with_shingles(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted(doc, name, row, ...) with n and the shingles of its set, read from the texts of the documents named."""
    import numpy as np

    wanted = wanted.withColumnRenamed("doc", "doc_")
    n = wanted.count()
    few = n <= BROADCAST_IDS
    texts = docs.select("doc_id", "text")
    texts = texts if few else likely_rows(texts, wanted, n)
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("doc_"))).drop("doc_id", "doc_")
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, found in batches_of_texts(batch):
                sets = [shingle_names(t, words) for t in found]
                same = [k for k, (own, name) in enumerate(zip(sets, part.column("name").to_pylist())) if set_name(own) == name]
                if same:
                    own = [sets[k].view(np.int64) for k in same]
                    grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate(own)))
                    cut = part.take(pa.array(same))
                    yield pa.RecordBatch.from_arrays([*[cut.column(c) for c in rest], pa.array([len(x) for x in own], pa.int64()), grams], names=[*rest, "n", "grams"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.drop("text").schema)
    return texts.mapInArrow(run, f"{schema}, n long, grams array<long>").drop("name").dropDuplicates(["row"])


def linked_pairs(left: list, right: list | None, percent: int):
    """Positions (i, j) of pairs of sets that link, of left and right, or of left alone where i < j.

    Overlap counts accumulate over blocks of columns; a pair is discarded once its count and the smaller number of
    shingles left can't reach ceil(t (n + m) / (1 + t)).
    """
    import numpy as np

    both = left + (right or [])
    sizes = np.array([len(x) for x in both], np.int64)
    row = np.repeat(np.arange(len(both)), sizes)
    _, column, often = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], column[shared]
    if not len(row):
        return np.zeros(0, int), np.zeros(0, int)
    number = np.cumsum(often > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b = np.arange(len(left)), np.arange(len(left), len(both)) if right is not None else np.arange(len(left))
    rest = np.bincount(row, minlength=len(both))
    need = -(-percent * (sizes[a][:, None] + sizes[b][None, :]) // (100 + percent))
    count = np.zeros(need.shape, np.float32)
    alive = np.minimum(rest[a][:, None], rest[b][None, :]) >= need
    if right is None:
        alive &= a[:, None] < b[None, :]
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        use_a, use_b = alive.any(1), alive.any(0)
        if not use_a.all() or not use_b.all():
            a, b, alive, need, count = a[use_a], b[use_b], alive[use_a][:, use_b], need[use_a][:, use_b], count[use_a][:, use_b]
        if not len(a):
            break
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        here = np.zeros((len(both), min(COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        here[row[lo:hi], column[lo:hi] - first] = 1
        count += here[a] @ here[b].T
        rest = rest - np.bincount(row[lo:hi], minlength=len(both))
        alive &= count + np.minimum(rest[a][:, None], rest[b][None, :]) >= need
    i, j = np.nonzero(alive & (count >= need))
    return a[i], b[j] - (0 if right is None else len(left))


def stars(rows, i, j) -> pa.Table:
    """Edges u, v that connect what the pairs of positions connect, at most one for each row."""
    import numpy as np

    label = np.arange(len(rows))
    while len(i):
        u, v = label[i], label[j]
        if (u == v).all():
            break
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(rows)))
    return pa.table({"u": rows[moved], "v": rows[label[moved]]})


def rows_of(group: pa.Table) -> tuple:
    import numpy as np

    grams = group.column("grams").combine_chunks()
    flat, ends = grams.values.to_numpy(zero_copy_only=False).view(np.uint64), grams.offsets.to_numpy()
    return group.column("row").to_numpy(), [flat[p:q] for p, q in zip(ends, ends[1:])]


def small_block_links(members: DataFrame, percent: int) -> DataFrame:
    """Edges within blocks that are a tile each.  Blocks are dealt out to groups of about ENTRIES shingles."""
    total = members.agg(F.sum("n")).first()[0] or 0
    dealt = members.withColumn("deal", F.pmod(F.xxhash64("block"), F.lit(math.ceil(total / ENTRIES) + 1)))

    def run(group: pa.Table) -> pa.Table:
        out = []
        group = group.sort_by("block")
        for block in _runs(group):
            rows, sets = rows_of(block)
            out.append(stars(rows, *linked_pairs(sets, None, percent)))
        return pa.concat_tables(out)

    return dealt.groupBy("deal").applyInArrow(run, "u long, v long")


def _runs(group: pa.Table) -> Iterator[pa.Table]:
    """The rows of each block of a group that is sorted by block."""
    keys = group.column("block").to_pylist()
    first = 0
    for k in range(1, len(keys) + 1):
        if k == len(keys) or keys[k] != keys[first]:
            yield group.slice(first, k - first)
            first = k


def centre_links(members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Compare the rows of each block with its most typical one, then those left with their own, CENTRES times.

    Gives the edges, and members with a label: rows with one label above -1 are linked to one row.
    """
    labelled, edges = members.withColumn("label", F.lit(-1)), None
    for k in range(CENTRES):
        left = labelled.filter("label = -1")
        centre = left.groupBy("block").agg(F.max_by("row", F.struct("typical", "row")).alias("centre"))
        centre = save(centre.join(members.select(F.col("row").alias("centre"), F.col("n").alias("m"), F.col("grams").alias("theirs")), "centre"), "centres")
        common = F.size(F.array_intersect("grams", "theirs"))
        hit = (F.col("label") == -1) & (100 * common >= percent * (F.col("n") + F.col("m") - common))
        seen = labelled.join(centre, "block", "left").withColumn("label", F.when(hit, k).otherwise(F.col("label")))
        labelled = save(seen.drop("m", "theirs"), "labelled")
        found = labelled.filter(f"label = {k} AND row != centre").select(F.col("row").alias("u"), F.col("centre").alias("v"))
        edges = found if edges is None else edges.unionByName(found)
        labelled = labelled.drop("centre")
    return edges, labelled


def tile_links(labelled: DataFrame, percent: int) -> DataFrame:
    """Edges of blocks in tiles: pairs of parts of a block that differ in label and may be close enough in size."""
    band = F.floor(F.log(F.col("n")) / math.log(100 / (percent - 1))).cast("int")
    rows = save(labelled.withColumn("band", band), "banded")
    parts = rows.groupBy("block", "label", "band").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / ROWS), F.ceil(F.sum("n") / ENTRIES)).cast("int").alias("k")
    )
    parts = save(parts, "parts")
    a = parts.select("block", F.col("label").alias("la"), F.col("band").alias("ba"), F.col("k").alias("ka"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("bb"))
    b = parts.select("block", F.col("label").alias("lb"), F.col("band").alias("bb"), F.col("k").alias("kb"))
    pairs = a.join(b, ["block", "bb"]).filter("(ba < bb OR la <= lb) AND (la != lb OR la = -1)")
    pairs = save(pairs, "tiles")
    same = (F.col("la") == F.col("lb")) & (F.col("ba") == F.col("bb"))
    tile, own = ["block", "la", "ba", "lb", "bb", "s", "t"], ["block", "label", "band"]
    salt = F.pmod(F.xxhash64("row"), F.col("ka")).cast("int")
    first = rows.join(pairs.withColumnsRenamed({"la": "label", "ba": "band"}), own).withColumnsRenamed({"label": "la", "band": "ba"})
    first = first.withColumn("salt", salt).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)))
    first = first.select(
        "row", "grams", F.when(same & (F.col("other") < F.col("salt")), 1).when(same & (F.col("other") == F.col("salt")), 2).otherwise(0).alias("side"),
        F.when(same, F.least("salt", "other")).otherwise(F.col("salt")).alias("s"), F.when(same, F.greatest("salt", "other")).otherwise(F.col("other")).alias("t"), *tile[:5],
    )
    second = rows.join(pairs.filter(~same).withColumnsRenamed({"lb": "label", "bb": "band"}), own).withColumnsRenamed({"label": "lb", "band": "bb"})
    second = second.withColumn("t", F.pmod(F.xxhash64("row"), F.col("kb")).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)))
    dealt = first.unionByName(second.select("row", "grams", F.lit(1).alias("side"), "s", "t", *tile[:5]))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        side = group.column("side").to_pylist()
        rows, sets = rows_of(group)
        if side[-1] == 2:
            return stars(rows, *linked_pairs(sets, None, percent))
        cut = side.count(0)
        if cut in (0, len(side)):
            return stars(rows[:0], [], [])
        i, j = linked_pairs(sets[:cut], sets[cut:], percent)
        return stars(rows, i, j + cut)

    return dealt.groupBy(*tile).applyInArrow(run, "u long, v long")


def jaccard_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id.

    A document's set is its distinct shingles of `words` words in ASCII lower case, the whole sequence as one if it has
    fewer.  Documents link if 100 times their sets' intersection is at least `percent` times their union; component_id
    is the smallest doc_id reachable.  Null, empty and blank texts have no shingle and link with nothing: component_id is
    their own.  Whole texts count, however long.  Equal texts and repeated rows link, each row stays; a null doc_id stays
    and names no component.  Other columns are ignored.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = save(shingle_sets(docs, words, percent), "shingles")
    sets = save(rows.filter("n > 0").groupBy("name", "n").agg(F.min("doc_id").alias("doc"), F.any_value("columns").alias("columns")).withColumn("row", F.monotonically_increasing_id()), "sets")  # numbers are fixed once written
    entries, listed = possible_rows(sets)
    found = save(blocks(entries), "blocks")
    discard(listed)
    members = save(with_shingles(docs, found.join(sets.select("row", "name", "doc"), "row"), words), "members")
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("entries"))
    large = save(sizes.filter((F.col("rows") > ROWS) | (F.col("entries") > ENTRIES)).select("block"), "large")
    edges = small_block_links(members.join(large, "block", "left_anti"), percent)
    if large.count():
        near, labelled = centre_links(save(members.join(large, "block", "left_semi"), "large"), percent)
        edges = edges.unionByName(near).unionByName(tile_links(labelled, percent))
    linked = save(components(edges), "linked")
    discard(members)
    named = sets.join(linked, sets["row"] == linked["node"], "left").select("name", "doc", F.coalesce("component", "row").alias("component"))
    named = save(named, "named")
    least = save(named.groupBy("component").agg(F.min("doc").alias("component_id")), "components")
    discard(sets)
    named = save(named.join(least, "component").select("name", "component_id"), "named")
    out = rows.join(named, "name", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
