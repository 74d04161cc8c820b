"""Masking of credentials in texts, with Spark's own expressions: candidates of all rules, spans without overlap, rewritten texts.

A rule's matches are found one after another from where the last one ended, so each comes with its place.  Overlapping
candidates are settled by start, severity and length before anything is rewritten, so a value is masked where it was
found and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import MASK, NO_SECRETS, SECRET_RULES, SEVERITIES
from ..functions import text as X

MODES = {"strict": SEVERITIES, "balanced": SEVERITIES[:2], "off": []}
#: Whatever a rule finds holds one of these, so texts without any are looked through once.
HINT = r"(?i)sk-|a[ks]ia|aiza|gh[pousr]_|xox[baprs]-|eyj|private key|bearer|jdbc:|key|secret|token|passw|pwd|database[_-]?url"
SPAN = "struct<start:int,rank:int,n:int,kind:string,mask:string>"


def plausible(value: Column) -> Column:
    """Long enough or with a digit, and no word that only stands for a secret."""
    v = F.regexp_replace(X.strip(value), "^[\"']+|[\"']+$", "")
    return (v != "") & ~F.lower(v).isin(NO_SECRETS) & ((F.length(v) >= 12) | F.rlike(v, F.lit(r"\p{Nd}")))


def candidates(text: Column, kind: str) -> Column:
    """The matches of one rule as SPANs: what is masked starts after `start` characters and is n long."""
    pattern, group, severity, keep = SECRET_RULES[kind]
    each = F.regexp_extract_all(text, F.lit(rf"(?s:\G.*?)(?:{pattern})"), F.lit(0))  # what precedes a match, and the match
    pieces = F.when(F.rlike(text, F.lit(pattern)), each).otherwise(F.array().cast("array<string>"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        # the lazy head of a piece ends where its first match begins, so this is the same match again
        value = F.regexp_extract(piece, rf"(?s:^.*?)(?:{pattern})", group) if group else F.regexp_extract(piece, rf"(?s:^.*?)({pattern})", 1)
        span = F.struct(
            (end - F.length(value)).alias("start"),
            F.lit(SEVERITIES.index(severity)).alias("rank"),
            F.length(value).alias("n"),
            F.lit(kind).alias("kind"),
            F.concat(F.left(value, F.lit(keep)), F.lit(MASK)).alias("mask"),
        )
        wanted = (F.length(value) > 0) & (plausible(value) if severity != "high" else F.lit(True))
        return F.struct(end.alias("at"), F.when(wanted, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def secret_spans(text: Column) -> Column:
    """The findings of all rules without overlap, in order: of two that overlap the earlier, then the more severe, then the longer stays."""
    order = {kind: i for i, kind in enumerate(SECRET_RULES)}
    keyed = lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), (-s["n"]).alias("less"),
        F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), s["kind"]).alias("rule"), s.alias("s"),
    )
    ordered = F.transform(F.array_sort(F.transform(F.concat(*[candidates(text, k) for k in SECRET_RULES]), keyed)), lambda k: k["s"])
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(f"array<{SPAN}>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["end"]
        return F.struct(
            F.when(fresh, s["start"] + s["n"]).otherwise(acc["end"]).alias("end"),
            F.when(fresh, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"),
        )

    found = F.aggregate(ordered, start, step, lambda acc: acc["kept"])
    return F.when(F.rlike(text, F.lit(HINT)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def masked(text: Column, spans: Column, mode: str = "balanced") -> Column:
    """The text with the spans of the mode's severities replaced by their masks."""
    ranks = [SEVERITIES.index(s) for s in MODES.get(mode, MODES["balanced"])]
    wanted = F.filter(spans, lambda s: s["rank"].isin(ranks)) if ranks else F.slice(spans, 1, 0)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct((s["start"] + s["n"]).alias("at"), F.concat(acc["out"], between, s["mask"]).alias("out"))

    return F.aggregate(wanted, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def findings(docs: DataFrame, key: str, text: str = "text", mode: str = "balanced") -> DataFrame:
    """key, kind, severity, line (from 1), preview, start and n per finding; none when the mode is off."""
    if mode == "off":
        return docs.select(key, F.explode(F.array().cast(f"array<{SPAN}>")).alias("s")).select(key, *_finding())
    t = X.text_of(F.col(text))
    seen = docs.select(key, t.alias("t"), secret_spans(t).alias("spans")).filter(F.size("spans") > 0)
    line = F.length(F.left("t", F.col("s.start"))) - F.length(F.replace(F.left("t", F.col("s.start")), F.lit("\n"), F.lit(""))) + 1
    return seen.select(key, "t", F.explode("spans").alias("s")).select(key, *_finding(line))


def _finding(line: Column | None = None) -> list[Column]:
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("s.rank") + 1)
    return [
        F.col("s.kind").alias("kind"),
        severity.alias("severity"),
        (F.lit(1) if line is None else line).cast("long").alias("line"),
        X.truncate(F.replace(F.col("s.mask"), F.lit("\n"), F.lit(" ")), 160).alias("preview"),
        F.col("s.start").cast("long").alias("start"),
        F.col("s.n").cast("long").alias("n"),
    ]


def redact(docs: DataFrame, text: str = "text", mode: str = "balanced") -> DataFrame:
    """docs with the findings of the mode's severities masked in `text`; a null text becomes an empty one."""
    t = X.text_of(F.col(text))
    if mode == "off":
        return docs.withColumn(text, t)
    spans = "spans" + "_" * max(map(len, docs.columns))  # longer than any other name
    return docs.withColumn(spans, secret_spans(t)).withColumn(text, masked(t, F.col(spans), mode)).drop(spans)


def redact_json(c: Column, mode: str = "balanced", depth: int = 40) -> Column:
    """A JSON text with every string value masked, names of fields left as they are.

    Strings are found as tokens of the text: a name is one that a colon follows.  Values nested deeper than `depth` stay.
    """
    return scanned_json(c, mode, depth)["text"]


def scanned_json(c: Column, mode: str = "balanced", depth: int = 40) -> Column:
    """As redact_json, with the kinds of all findings in order: struct(text, kinds)."""
    # possessive, as a group that may give back is a call a turn, and long strings exhaust the stack
    token = r'("(?:[^"\\]++|\\.)*+"\s*+:?|[\[\]{}]|[^"\[\]{}]++)'
    parts = F.regexp_extract_all(c, F.lit(token), F.lit(1))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("depth"), none.alias("out"), none.alias("kinds"))

    def step(acc: Column, p: Column) -> Column:
        value = F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"')) & (acc["depth"] <= depth)
        raw = F.try_variant_get(F.try_parse_json(p), "$", "string")
        out = F.when(value, F.to_json(F.array(masked(raw, secret_spans(raw), mode)))).otherwise(p)
        bare = F.when(value, F.substring(out, F.lit(2), F.length(out) - 2)).otherwise(p)
        kinds = F.when(value, F.concat(acc["kinds"], F.transform(secret_spans(raw), lambda s: s["kind"]))).otherwise(acc["kinds"])
        change = F.when(p.isin("{", "["), 1).when(p.isin("}", "]"), -1).otherwise(0)
        return F.struct((acc["depth"] + change).alias("depth"), F.concat(acc["out"], F.array(bare)).alias("out"), kinds.alias("kinds"))

    return F.aggregate(parts, start, step, lambda acc: F.struct(F.array_join(acc["out"], "").alias("text"), acc["kinds"].alias("kinds")))


def redact_documents(documents: DataFrame, keys: list[str], mode: str = "balanced", valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """documents with every string of their columns masked, but for the keys, and `findings`, the kinds found in each.

    A document goes through JSON and back.  Where its masked form isn't read as what it was (a column's type doesn't take
    it, or `valid` of the struct of columns says no) the document stays as it was, and has no findings.
    """
    kinds = T.StructType([f for f in documents.schema if f.name not in keys])
    bad, own = "_bad", "_document"
    while bad in documents.columns or own in documents.columns:
        bad, own = bad + "_", own + "_"
    body = F.to_json(F.struct(*kinds.names), {"ignoreNullFields": "false"})
    rows = documents.withColumn(own, F.struct(scanned_json(body, mode).alias("seen")))
    read = F.from_json(F.col(f"{own}.seen.text"), T.StructType([*kinds, T.StructField(bad, T.StringType())]), {"columnNameOfCorruptRecord": bad})
    rows = rows.withColumn(own, F.struct(F.col(f"{own}.seen.kinds").alias("kinds"), read.alias("read")))
    good = (F.size(f"{own}.kinds") > 0) & F.col(f"{own}.read").isNotNull() & F.col(f"{own}.read.{bad}").isNull()
    if valid is not None:
        good = good & F.coalesce(valid(F.col(f"{own}.read")), F.lit(False))
    back = {n: F.when(good, F.col(f"{own}.read.`{n}`")).otherwise(F.col(f"`{n}`")) for n in kinds.names}
    return rows.withColumns(back | {"findings": F.when(good, F.col(f"{own}.kinds")).otherwise(F.array().cast("array<string>"))}).drop(own)
