"""Secret scans with DataFrame functions alone: fixed patterns, and character Markov models.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples.  A candidate, a run of the characters that keys are written in, is a secret if the log of the ratio of its
likelihoods under the two models is above BOUND, and on average above BOUND_PER_CHARACTER.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text

#: kind: pattern, group that is measured, its least length.  A match that is too short is dropped, not shortened.
BASE = {
    "assign": (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # the runs of [0-9a-f]+ that are long enough
}
METHOD = "markov"
#: Candidates of the method, and the characters that its models know.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
BOUND, BOUND_PER_CHARACTER = 16.0, 0.9
#: Added to every count of a pair of characters.
SMOOTHING = 0.5
MASK = "[SECRET]"

#: Words of ordinary identifiers, from which labelled samples are made.
WORDS = (
    "account action address agent amount archive article author balance batch border bucket buffer button cache calendar "
    "category channel client column comment community config connection content context control counter country currency "
    "customer data database default delivery department description detail device directory document education element "
    "email employee environment error event example export factory feature field file filter folder format function "
    "general government group handler header health history image import index information input instance interface "
    "international invoice item journal label language layout length level library license limit link list location "
    "manager market measure member memory message method model module month name network node notification number object "
    "option order output owner package page parameter parent partner password path payment period person picture place "
    "policy position price process product profile project property provider query question random record region register "
    "report request resource response result return review schedule schema school search section security segment select "
    "server service session setting signal size source stage state station status storage stream string student support "
    "system table target template thread ticket token total traffic transaction transfer update user value vector version "
    "view warehouse website window worker workflow"
)


def labelled_samples(spark: SparkSession, each: int = 3000) -> DataFrame:
    """text, is_random: identifiers joined from words in several styles, and random strings in several alphabets."""
    words = F.split(F.lit(WORDS), " ")
    n = len(WORDS.split())
    pick = lambda salt: F.get(words, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int"))
    part = [pick(f"word{k}") for k in range(4)]
    style = F.col("id") % 6
    ordinary = (
        F.when(style == 0, F.concat_ws("_", *part[:3]))
        .when(style == 1, F.concat_ws("-", *part))
        .when(style == 2, F.concat(part[0], *[F.initcap(p) for p in part[1:3]]))
        .when(style == 3, F.upper(F.concat_ws("_", *part[:3])))
        .when(style == 4, F.concat_ws("/", *part))
        .otherwise(F.concat(*part[:2], F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")))
    )
    noise = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    packed = F.base64(F.unhex(noise))
    drawn = (
        F.when(style < 3, F.substring(packed, 1, 40))
        .when(style == 3, F.substring(noise, 1, 40))
        .when(style == 4, F.translate(F.substring(packed, 1, 32), "+/=", "-_"))
        .otherwise(F.upper(F.regexp_replace(packed, "[+/=]", "")))
    )
    ids = spark.range(each)
    return ids.select(ordinary.alias("text"), F.lit(False).alias("is_random")).unionByName(
        ids.select(drawn.alias("text"), F.lit(True).alias("is_random"))
    )


def pairs(text: Column) -> Column:
    """Each pair of neighbouring characters as one number; a character is its place in ALPHABET, from 1, or 0."""
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(text, i, F.lit(1)))
    at = F.when(F.length(text) > 1, F.sequence(F.lit(2), F.length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: place(i - 1) * (len(ALPHABET) + 1) + place(i))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters: random against ordinary.  A table of fixed size."""
    size = len(ALPHABET) + 1
    rows = samples.filter("text != ''").select("is_random", F.explode(pairs(F.col("text"))).alias("pair")).groupBy("is_random", "pair").count().collect()
    counts = {kind: [SMOOTHING] * (size * size) for kind in (True, False)}
    for r in rows:
        counts[r["is_random"]][r["pair"]] += r["count"]
    log = {}
    for kind, c in counts.items():
        totals = [sum(c[a * size : a * size + size]) for a in range(size)]
        log[kind] = [math.log(x / totals[i // size]) for i, x in enumerate(c)]
    return [a - b for a, b in zip(log[True], log[False])]


def ratio(text: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a text over its pairs of characters."""
    values = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")
    return F.aggregate(pairs(text), F.lit(0.0), lambda total, i: total + F.get(values, i))


def matches(text: Column, pattern: str) -> Column:
    """The non-overlapping matches, as structs: start, end, match.

    Each piece found is what precedes a match, and the match; so the pieces' lengths give the positions.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?:{pattern})"), F.lit(0))
    none = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.transform(
            F.array(F.regexp_extract(piece, pattern, 0)),
            lambda m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match")),
        )
        return F.struct(end.alias("at"), F.concat(acc["found"], span).alias("found"))

    return F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def spans_of(text: Column, kind: str, order: int, pattern: str, keep) -> Column:
    """The matches for which keep(match) holds, as structs: start, order, kind, end."""
    return F.transform(
        F.filter(matches(text, pattern), lambda s: keep(s["match"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), s["end"].alias("end")),
    )


def found_in(spark: SparkSession, text: Column, samples: DataFrame | None = None) -> Column:
    """What patterns (`base`) and models (`more`) find in a text that isn't null: two arrays of struct(start, order, kind, end).

    samples(text, is_random) train the models; by default labelled_samples.
    """
    table = train(samples if samples is not None else labelled_samples(spark))
    long_enough = lambda pattern, group, least: lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least
    base = [spans_of(text, kind, i, p, long_enough(p, group, least)) for i, (kind, (p, group, least)) in enumerate(BASE.items())]
    random = lambda m: ratio(m, table) >= F.greatest(F.lit(BOUND), F.length(m) * BOUND_PER_CHARACTER)
    more = spans_of(text, METHOD, len(BASE), CANDIDATE, random)
    return F.struct(F.array_sort(F.concat(*base)).alias("base"), more.alias("more"))


def all_spans(found: Column) -> Column:
    """The patterns' spans, and the models' unless one of the patterns' covers it, by start, then kind."""
    uncovered = F.filter(found["more"], lambda m: ~F.exists(found["base"], lambda b: (b["start"] <= m["start"]) & (m["end"] <= b["end"])))
    return F.array_sort(F.concat(found["base"], uncovered))


def scan_secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """docs with `base` and `spans`: arrays of struct(start, order, kind, end) by start, then kind.

    Positions are code points, ends are exclusive.  base holds what the patterns of BASE find, spans also what the
    models find, unless one of them covers it.  samples(text, is_random) train the models; by default labelled_samples.
    A null text is an empty one and has no spans; texts of any length are scanned whole.  Columns named base and spans
    are replaced, others and repeated rows stay.  An empty table gives an empty result.
    """
    found = "found" + "_" * max(map(len, docs.columns))  # longer than any other name
    others = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.withColumn(found, found_in(docs.sparkSession, plain_text(), samples))
    return rows.select(*others, F.col(found)["base"].alias("base"), all_spans(F.col(found)).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets_digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each stretch of overlapping or touching spans replaced by `mask`."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = (s["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], between, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))
