"""Source divergence audit: how far the sources of a language differ in their use of its common terms.

Documents are read twice.  First every task adds the terms of its documents, once for each document, to a count-min
sketch per language and term; merged, it never underestimates, so a term that it puts below the least number of documents
is impossible and is discarded before anything is shuffled.  Then the terms that are left are counted exactly, within
tasks first.  Sources are compared over the terms that both have; all others follow from sums over one source's terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save, small_batches
from .count_min import counts_of, merged_sketch

#: A term is kept in a language if it is in so many of its documents (at most 255, where sketches end).
LEAST_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
#: Terms listed for each group.
TOP_TERMS = 50
BITS, DEPTH = 21, 4
#: Counts that a task holds before it sends them on, terms whose verdict it remembers, bytes of a text split at once.
HELD = 1 << 18
AT_ONCE = 1 << 22
#: Bytes of a text: letters in lower case and all bytes beyond ASCII stay, the rest become spaces.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists that cover it: runs of letters and characters beyond ASCII, A-Z lowered."""
    data = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + AT_ONCE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_hashes(lang: str, terms: list[bytes]):
    """64-bit hashes of terms within a language."""
    import numpy as np
    import xxhash

    own = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), seed=1))
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64, len(terms)) ^ own


def plain_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, str, str]]:
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*[[x or "" for x in part.column(c).to_pylist()] for c in ("lang", "source", "text")])


def counted_terms(docs: DataFrame, least: int) -> DataFrame:
    """docs(lang, source, text) to lang, source, term, documents, occurrences of terms that may reach `least` documents.

    Exact sums are of all rows of a term; a row without a term stands for every group that occurs.
    """
    import numpy as np

    def hashes(batch: pa.RecordBatch) -> Iterator:
        for lang, _, text in plain_rows(batch):
            found = set()
            for terms in terms_of(text):
                found.update(terms)
            yield term_hashes(lang, list(found))

    rows = docs.select("lang", "source", "text")
    sketch = docs.sparkSession.sparkContext.broadcast(merged_sketch(rows, hashes, BITS, DEPTH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[set[bytes], set[bytes]]] = {}
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def learn(lang: str, terms: set[bytes], good: set[bytes], bad: set[bytes]) -> set[bytes]:
            """Sort terms into good and bad; those returned are too long to be remembered."""
            if len(good) + len(bad) + len(terms) > HELD:
                good.clear()
                bad.clear()
            new = list(terms - good - bad)
            if new:
                verdicts = (counts_of(sketch.value, term_hashes(lang, new)) >= least).tolist()
                good.update(t for t, v in zip(new, verdicts) if v)
                bad.update(t for t, v in zip(new, verdicts) if not v)
            return {t for t in new if len(t) > 64}

        def packed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (documents, occurrences) in held.items():
                terms = [None, *documents]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms)),
                        pa.array([source] * len(terms)),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array([0, *documents.values()], pa.int64()),
                        pa.array([0, *[occurrences[t] for t in documents]], pa.int64()),
                    ],
                    names=["lang", "source", "term", "documents", "occurrences"],
                )

        for batch in batches:
            for lang, source, text in plain_rows(batch):
                documents, occurrences = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(documents), set()
                good, bad = known.setdefault(lang, (set(), set()))
                for terms in terms_of(text):
                    distinct = set(terms)
                    long = learn(lang, distinct, good, bad)
                    occurrences.update(filter(good.__contains__, terms))
                    seen |= distinct & good
                    good -= long
                    bad -= long
                documents.update(seen)
                size += len(documents) - before
                if size > HELD:
                    yield from packed()
                    held, size = {}, 0
        yield from packed()

    counts = rows.mapInArrow(run, "lang string, source string, term string, documents long, occurrences long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("n"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in whole numbers."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)"))
    with_ = (total + PRIOR * kept).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", over, with_)).cast("long")


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """Per group (lang, source) of docs(lang, source, text, ...): its distance from each other source and its own terms.

    Rows are lang, source, part, item, value, rank.  Part `pair` has each other source of the language, by the sum of
    differences of shares over the language's kept terms, the largest first.  Part `term` has the terms that are more
    frequent in the group than in the language, the `top` largest differences.  Ties go by item in byte order.

    Null text, lang and source are empty; groups without terms, and languages without kept terms, have their pairs, with
    value 0 where there is no kept term.  Repeated rows count as often as they occur, whole texts count, however long.
    Other columns are ignored.  An empty table gives an empty result.
    """
    if not 0 < least <= 255:
        raise ValueError("least has to be from 1 to 255")
    small_batches(docs.sparkSession)
    counted = save(counted_terms(docs, least), "counted")
    terms = counted.filter("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n_lang")).filter(F.col("documents") >= least)
    kept = save(kept.drop("documents"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("total_lang"))
    own = save(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("size"))
    groups = counted.filter("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "size", "v", "total_lang"])
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0).alias("zero")
    groups = save(groups.select("*", zero), "groups")
    shares = own.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "zero", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q")
    )
    shares = save(shares, "shares")

    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value).alias("rank")
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.select("*", rank).filter(F.col("rank") <= top)
    pairs = pair_values(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return above.unionByName(pairs.select("*", rank))


def pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the sum of abs(p - q) over all kept terms.

    Of the v terms, those of neither source give abs(zero - zero'), those of one source its p against the other's zero;
    both are sums over that source's distinct values of p.  Terms of both correct these sums by the sparse join.
    """
    a = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    b = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    extra = F.abs(F.col("pa") - F.col("pb")) - F.abs(F.col("pa") - F.col("zb")) - F.abs(F.col("za") - F.col("pb")) + F.abs(F.col("za") - F.col("zb"))
    common = a.join(b, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(extra).alias("common"))
    heights = save(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")), "heights")
    two = [groups.select("lang", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "size", "zero")], *(["v"] if x == "a" else [])) for x in "ab"]
    pairs = save(two[0].join(two[1], "lang").filter("source_a != source_b"), "pairs")
    alone = pairs.join(heights.withColumnRenamed("source", "source_a"), ["lang", "source_a"])
    alone = alone.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("times") * F.abs(F.col("p") - F.col("zero_b"))).alias("alone"))
    back = alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), F.col("alone").alias("alone_b"))
    both = pairs.join(alone, ["lang", "source_a", "source_b"], "left").join(back, ["lang", "source_a", "source_b"], "left")
    both = both.withColumns({"a": F.least("source_a", "source_b"), "b": F.greatest("source_a", "source_b")}).join(common, ["lang", "a", "b"], "left")
    none = (F.col("v") - F.col("size_a") - F.col("size_b")) * F.abs(F.col("zero_a") - F.col("zero_b"))
    sums = [F.coalesce(c, F.lit(0)) for c in ("alone", "alone_b", "common")]
    return both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), (none + sums[0] + sums[1] + sums[2]).cast("long").alias("value"))
