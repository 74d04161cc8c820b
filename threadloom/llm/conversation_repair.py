"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A retained-subsequence dynamic programme: of a conversation's turns some are retained, as they are or with another role,
and all others are deleted.  What lies between two neighbouring retained turns is priced without looking at it: the
deletions by the difference of two prefix sums, the insertions by the pair of roles alone.  So it is enough to carry, for
each role that the next retained turn may have, one running minimum.  Costs are computed from the last turn to the first;
from the first to the last the audit then takes the least letter in byte order of those that keep to the cheapest cost.

Turns are numbered by a window and written; the programme runs over their features alone, streamed conversation by
conversation; texts are hashed in order as they pass.  Of one conversation a task holds some bytes a turn, and no texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, small_batches

DELETE, CHANGE, TRUNCATED = 4, 3, 3
WORD = r"[^\x20\x09-\x0D]"
UNENDED = r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
LEGAL_PAIRS = ("su", "ua", "au")
#: What is inserted between two retained roles, before the first (after "") and after the last (before "").
INSERTS = {
    "": {"s": "", "u": "", "a": "u", "": ""},
    "s": {"u": "", "a": "u", "": "ua"},
    "u": {"u": "a", "a": "", "": "a"},
    "a": {"u": "", "a": "u", "": ""},
}
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60


def damage(turns: DataFrame) -> DataFrame:
    """Damage turns(conv_id, turn, role, text) by crc32 of `conv_id:turn`, modulo 20; nulls are one space, but for a null turn's place.

    0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats it, 4 makes its role user.
    """
    plain = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *plain[:2])) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(plain[2])
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(plain[3], ".!?", "")).otherwise(plain[3])
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    row = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))
    return row.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """turns with pos (from 0 per conversation, by turn, nulls first, then role and text), their first fault and role initial."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = F.row_number().over(W.partitionBy("conv_id", "role", "said").orderBy("pos")) > 1
    fault = F.when(~F.rlike("text", F.lit(WORD)), "blank").when(earlier, "duplicate").when(F.rlike("text", F.lit(UNENDED)), "truncated")
    rows = turns.withColumn("pos", F.row_number().over(order) - 1).withColumn("said", F.sha2("text", 256))
    return rows.withColumn("fault", fault).withColumn("initial", F.left("role", F.lit(1))).drop("said")


def cheapest_edits(initials: list[str], faults: list[str | None]) -> tuple[int, Iterator[tuple[str, str]]]:
    """The cost, and per turn its edits' letters (insertions before it included) and the roles they leave.

    The last entry is what is inserted at the end.  A turn that isn't retained leaves no role of its own.
    """
    n, roles = len(initials), "sua"

    def price(k: int, role: str) -> int:
        if faults[k] in ("blank", "duplicate") or role == "s" != initials[k]:
            return FAR
        return (0 if initials[k] == role else CHANGE) + (TRUNCATED if faults[k] == "truncated" else 0)

    def inserts(before: str, after: str) -> int:
        return CHANGE * len(INSERTS[before][after]) if after in INSERTS[before] else FAR

    # best[x]: over all later turns, the least of a deletion of all turns before it, its price as x and what follows
    best = dict.fromkeys(roles, FAR)
    after = {r: array("q", bytes(8 * (n + 1))) for r in ("", *roles)}  # what all from a turn on costs, by the last retained role
    for k in range(n, -1, -1):
        for r, costs in after.items():
            costs[k] = min(DELETE * n + inserts(r, ""), *(best[x] + inserts(r, x) for x in roles)) - DELETE * k
        for x in roles if k else "":
            best[x] = min(best[x], DELETE * (k - 1) + price(k - 1, x) + after[x][k])

    def walk() -> Iterator[tuple[str, str]]:
        last = ""
        for k in range(n):
            left = after[last][k]
            if DELETE + after[last][k + 1] == left:
                yield "D", ""
                continue
            fits = [x for x in roles if inserts(last, x) + price(k, x) + after[x][k + 1] == left]
            letters = {x: "I" * len(INSERTS[last][x]) + ("K" if x == initials[k] else "R") for x in fits}
            role = min(fits, key=letters.get)
            yield letters[role], INSERTS[last][role] + role
            last = role
        end = INSERTS[last][""]
        yield "I" * len(end), end

    return after[""][0], walk()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, pa.RecordBatch]]:
    """The stretches of one conv_id in sorted batches: conv_id, whether it is a new one, rows."""
    last: object = runs
    for batch in batches:
        keys = batch.column("conv_id").to_pylist()
        first = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                yield keys[first], last is runs or keys[first] != last, batch.slice(first, k - first)
                last, first = keys[first], k


def edits(numbered: DataFrame) -> DataFrame:
    """Per turn of numbered(conv_id, pos, initial, fault) and once after the last: conv_id, pos, letters, roles, cost.

    cost is the conversation's, on its last row alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kind, initials, faults = None, None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            cost, found = cheapest_edits(initials, faults)
            for at in range(0, len(initials) + 1, 1 << 16):
                part = list(islice(found, 1 << 16))
                n, costs = len(part), [None] * len(part)
                if at + n > len(initials):
                    costs[-1] = cost
                arrays = [pa.array([key] * n, kind), pa.array(range(at, at + n), pa.int32()), pa.array([x for x, _ in part]), pa.array([r for _, r in part]), pa.array(costs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "pos", "letters", "roles", "cost"])

        for conv, new, rows in runs(batches):
            if new:
                if initials:
                    yield from done()
                key, initials, faults, kind = conv, [], [], rows.schema.field("conv_id").type
            initials += rows.column("initial").to_pylist()
            faults += rows.column("fault").to_pylist()
        if initials:
            yield from done()

    rows = numbered.select("conv_id", "pos", "initial", "fault").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    kind = numbered.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, pos int, letters string, roles string, cost long")


def repaired_turns(numbered: DataFrame, edited: DataFrame) -> DataFrame:
    """The turns after repair: conv_id, pos (of the turn that they come from or go before), k, role, text.

    Inserted turns have an empty text, changed ones their text under the new role.
    """
    of = F.posexplode(F.split("roles", "")).alias("k", "initial_")
    some = edited.filter("roles != ''").select("conv_id", "pos", F.right("letters", F.lit(1)).alias("edit"), F.length("roles").alias("many"), of)
    some = some.filter("initial_ != ''").withColumnRenamed("conv_id", "conv_").withColumnRenamed("pos", "pos_")
    rows = some.join(numbered.select("conv_id", "pos", "role", "text"), F.col("conv_").eqNullSafe(F.col("conv_id")) & (F.col("pos_") == F.col("pos")), "left")
    own = (F.col("k") == F.col("many") - 1) & (F.col("edit") != "I")
    named = F.when(F.col("initial_") == "u", NAMES["u"]).otherwise(NAMES["a"])
    role = F.when(own & (F.col("edit") == "K"), F.col("role")).otherwise(named)
    return rows.select(F.col("conv_").alias("conv_id"), F.col("pos_").alias("pos"), "k", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def conversation_hashes(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's `role:text`, joined by newlines; rows pass in order, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, kind = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for conv, new, rows in runs(batches):
            if new:
                if digest:
                    yield done()
                key, digest, kind = conv, hashlib.sha256(), rows.schema.field("conv_id").type
            for k, (role, text) in enumerate(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist())):
                digest.update(f"{'' if new and not k else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        if digest:
            yield done()

    kind = repaired.schema["conv_id"].dataType.simpleString()
    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "k").select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_audit(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Per conversation of turns(conv_id, turn, role, text, ...): its faults, the cost and audit of its repair, the result's hash.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.  A turn is kept (K, free),
    given the role user or assistant (R, 3) or deleted (D, 4; blank and repeated turns have to be), and empty turns of
    either role are inserted (I, 3) so that role initials read (s?(ua)+)?; truncated turns that stay cost 3 more.
    Of the cheapest audits the least in byte order counts.

    Turns go by turn, nulls first, then role and text.  Null roles and texts are one space; null turns aren't counted for
    gaps.  A role that is empty or of another initial has to be changed or deleted.  Rows without a conv_id are one
    conversation.  Repeated rows are turns of their own, and faults.  Texts of any length are read whole.
    `conversations` lists conv_ids that may have no turn left: they get zeros and the hash of an empty string.  An audit is
    one value, so a conversation is one row of the result.  Other columns are ignored.  An empty table gives an empty result.
    """
    small_batches(turns.sparkSession)
    blank = F.lit(" ")
    plain = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    numbered = save(numbered_turns(plain), "turns")
    edited = save(edits(numbered), "edits")
    before = F.lag("initial").over(W.partitionBy("conv_id").orderBy("pos"))
    illegal = before.isNotNull() & ~F.concat(before, "initial").isin(*LEGAL_PAIRS)
    counts = [F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    narrow = numbered.select("conv_id", "turn", "fault", illegal.alias("illegal"))
    faults = narrow.groupBy("conv_id").agg(*counts, F.count(F.when(F.col("illegal"), 1)).alias("illegal"), gaps)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letters"))), lambda x: x["letters"]), "").alias("audit")
    audits = edited.groupBy("conv_id").agg(F.max("cost").alias("cost"), letters)
    hashes = conversation_hashes(repaired_turns(numbered, edited))
    out = (turns if conversations is None else conversations).select("conv_id").distinct()
    for part in (faults, audits, hashes):
        key = part.withColumnRenamed("conv_id", "conv_")
        out = out.join(key, F.col("conv_id").eqNullSafe(F.col("conv_")), "left").drop("conv_")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
