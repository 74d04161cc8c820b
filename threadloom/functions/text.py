"""Text functions of the session log engine.

Each takes and returns a Column and treats a null as an empty text unless it says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import (
    ENVELOPE_LINE, EXIT_CODES, FAILURE_HINT, FENCED, KEY_IGNORES, LABEL, LINE_ENDS, MARKDOWN_LINK, NOISE_LINE, OUTPUT_HEADER, PATCH_FILE, PROMPT_GOAL,
    PROMPT_OPENING, PROMPT_REQUIREMENT, SENTENCE_ENDS, SHELL_CHARACTERS, SHELL_STAND_INS, SPACE, STRONG_ERRORS, STRONG_FAILURE, TITLE_NOISE, TRAILING, URL,
    WEAK_ERRORS,
)

#: A sequence that sets a terminal's colours and the like.
ANSI = r"\x1b\[[0-9;]*[a-zA-Z]"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(text_of(c), f"^{SPACE}+|{SPACE}+$", "")


def truncate(c: Column, limit: int, suffix: str = "...") -> Column:
    """The stripped text, or as much of it as fits `limit` with the suffix."""
    t = strip(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.left(t, F.lit(limit - len(suffix))), F.lit(suffix)))


def collapse(c: Column) -> Column:
    """Runs of blanks become one, three and more line ends two."""
    blanks = F.regexp_replace(text_of(c), r"[\x20\x09　]+", " ")
    return strip(F.regexp_replace(blanks, r"\n{3,}", "\n\n"))


def lines(c: Column) -> Column:
    return F.split(text_of(c), LINE_ENDS)


def any_of(words: list[str]) -> str:
    """A pattern for any of the words, as they are."""
    return "|".join("".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in w) for w in words)


def first_line(c: Column, limit: int = 120) -> Column:
    """The first line that isn't empty without white space, and then `#`, around it."""
    bare = F.transform(lines(c), lambda x: strip(F.regexp_replace(strip(x), "^#+|#+$", "")))
    return truncate(F.coalesce(F.get(F.filter(bare, lambda x: x != ""), F.lit(0)), F.lit("")), limit)


def estimate_tokens(c: Column) -> Column:
    """One per ideograph, and one per four other characters, at least one if there are any."""
    t = text_of(c)
    wide = F.length(F.regexp_replace(t, r"[^一-鿿]", ""))
    other = F.length(t) - wide
    return (wide + F.when(other > 0, F.greatest(F.lit(1), F.floor(other / 4))).otherwise(0)).cast("long")


def without_trailing(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"^{TRAILING}+|{TRAILING}+$", "")


def first_sentence(c: Column, limit: int = 60) -> Column:
    """The first sentence of two characters or more without punctuation around it, else the whole text."""
    parts = F.filter(F.transform(F.split(text_of(c), SENTENCE_ENDS), without_trailing), lambda x: F.length(x) >= 2)
    return truncate(F.coalesce(F.get(parts, F.lit(0)), without_trailing(c)), limit)


def dedupe_key(c: Column, n: int = 60) -> Column:
    """The first n characters without white space and punctuation."""
    return F.left(F.regexp_replace(text_of(c), KEY_IGNORES, ""), F.lit(n))


def once(c: Column, f) -> Column:
    """f(c), where f names its argument more than once: c is computed a single time."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def first_error_line(c: Column, limit: int = 200) -> Column:
    """The first line with a strong error word, else with a weak one, else an empty text.  Lines that describe a process don't count.

    Lines are only looked at in texts that hold a word at all.
    """
    has = lambda x, words: F.rlike(F.lower(x), F.lit(any_of(words)))
    told = lambda t: F.filter(F.transform(F.split(t, LINE_ENDS), strip), lambda x: (x != "") & ~F.rlike(x, F.lit(NOISE_LINE)))
    first = lambda found, words: F.get(F.filter(found, lambda x: has(x, words)), F.lit(0))
    pick = lambda found: F.coalesce(first(found, STRONG_ERRORS), first(found, WEAK_ERRORS), F.lit(""))
    plain = F.regexp_replace(text_of(c), ANSI, "")
    line = once(plain, lambda t: F.when(has(t, STRONG_ERRORS + WEAK_ERRORS), once(told(t), pick)).otherwise(""))
    return once(line, lambda x: truncate(x, limit))


def table_cell(c: Column, limit: int = 160) -> Column:
    """A text as it may stand in a Markdown table."""
    flat = F.replace(F.replace(text_of(c), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    cut = truncate(flat, limit)
    return F.when(cut == "", "-").otherwise(cut)


def clip(c: Column, n: int) -> Column:
    flat = strip(F.replace(text_of(c), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n - 1)), F.lit("…")))


def short_hash(c: Column, n: int = 8) -> Column:
    return F.left(F.sha1(text_of(c)), F.lit(n))


def slug(c: Column, n: int = 60, fallback: str = "item") -> Column:
    """Letters, digits, `-`, `_` and ideographs stay, separators become single hyphens, the rest goes."""
    separated = F.regexp_replace(strip(c), r"[ /\\:*?\"<>|.\n\t]", "-")
    kept = F.regexp_replace(F.regexp_replace(separated, r"[^\p{L}\p{N}_-]", ""), "-{2,}", "-")
    bare = F.left(F.regexp_replace(kept, "^-+|-+$", ""), F.lit(n))
    return F.when(bare == "", fallback).otherwise(bare)


def safe_name(c: Column, n: int = 120) -> Column:
    return F.left(F.regexp_replace(text_of(c), r"[^\p{L}\p{N}_.-]", "_"), F.lit(n))


def strip_ansi(c: Column) -> Column:
    return strip(F.regexp_replace(text_of(c), ANSI, ""))


def exit_code(c: Column) -> Column:
    """The exit code that a tool's output states, by the first pattern that occurs, or null."""
    stated = F.coalesce(*[F.nullif(F.regexp_extract(text_of(c), p, 1), F.lit("")) for p in EXIT_CODES])
    return stated.try_cast("int")


def looks_failed(code: Column, output: Column) -> Column:
    """The exit code decides; without one a strong sign in the first 600 characters, or a weak one in their first 3 lines."""
    head = F.left(text_of(output), F.lit(600))
    few = F.array_join(F.slice(lines(head), 1, 3), "\n")
    return F.coalesce(code != 0, F.rlike(head, F.lit(STRONG_FAILURE)) | F.rlike(few, F.lit(FAILURE_HINT)))


def without_envelope(c: Column) -> Column:
    """A tool's output without the lines that wrap it; nothing, if there was nothing else."""
    t = text_of(c)
    wrapped = F.rlike(t, F.lit(ENVELOPE_LINE)) | F.rlike(t, F.lit(OUTPUT_HEADER))
    bare = F.regexp_replace(t, ENVELOPE_LINE, "")
    # the first header alone goes: a split in two at the header leaves later ones in the second part
    body = strip(F.array_join(F.split(bare, OUTPUT_HEADER, 2), ""))
    return F.when(body != "", body).when(wrapped, "").otherwise(strip(t))


def iso_time(c: Column) -> Column:
    """An ISO time, also with a blank between date and time, or null."""
    t = strip(c)
    return F.coalesce(F.try_to_timestamp(t), *[F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXX", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd HH:mm:ss")])


def unbalanced_opener(line: Column) -> Column:
    """The place (from 1) of the first `[` or `{` from which on a line opens more than it closes, or null.

    Going backwards the balance of a suffix is a running sum, so the place is found in one pass.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("int").alias("at"), F.length(line).alias("i"))

    def step(acc: Column, ch: Column) -> Column:
        opens = ch.isin("[", "{")
        depth = acc["depth"] + F.when(opens, 1).when(ch.isin("]", "}"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.when(opens & (depth > 0), acc["i"]).otherwise(acc["at"]).alias("at"), (acc["i"] - 1).alias("i"))

    return F.aggregate(F.reverse(F.split(line, "")), start, step)["at"]


def balance(c: Column) -> Column:
    """How many brackets a text opens beyond those that it closes."""
    count = lambda chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return count("[{") - count("]}")


def without_payloads(c: Column) -> Column:
    """A text without pasted JSON: from a bracket that its line leaves open until it is closed."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        bare = strip(line)
        at = unbalanced_opener(bare)
        prefix = strip(F.left(bare, at - 1))
        inside = F.struct(F.greatest(acc["depth"] + balance(bare), F.lit(0)).alias("depth"), acc["kept"].alias("kept"))
        plain = F.struct(F.lit(0).alias("depth"), F.concat(acc["kept"], F.array(line)).alias("kept"))
        opened = F.struct(
            F.greatest(balance(F.substring(bare, at, F.length(bare))), F.lit(0)).alias("depth"),
            F.when(prefix != "", F.concat(acc["kept"], F.array(prefix))).otherwise(acc["kept"]).alias("kept"),
        )
        return F.when(acc["depth"] > 0, inside).when(at.isNull(), plain).otherwise(opened)

    return F.array_join(F.aggregate(lines(c), start, step, lambda acc: acc["kept"]), "\n")


def clean_user_text(c: Column) -> Column:
    """What a user wrote without fenced blocks, pasted payloads, link targets and addresses."""
    prose = without_payloads(F.regexp_replace(text_of(c), FENCED, " "))
    return collapse(F.regexp_replace(F.regexp_replace(prose, MARKDOWN_LINK, "$1"), URL, " "))


def unwrapped_prompt(c: Column) -> Column:
    """The goal inside a prompt that an earlier migration made, or null for any other text."""
    t = strip(c)
    after = F.when(F.contains(t, F.lit(PROMPT_GOAL)), F.substring(t, F.instr(t, F.lit(PROMPT_GOAL)) + len(PROMPT_GOAL), F.length(t))).otherwise(t)
    goal = strip(F.regexp_replace(strip(F.substring_index(after, PROMPT_REQUIREMENT, 1)), "^[：:]+|[：:]+$", ""))
    return F.when(F.contains(F.left(t, F.lit(80)), F.lit(PROMPT_OPENING)) & (goal != ""), goal)


def patch_stats(c: Column) -> Column:
    """Per file of a patch, in order: struct(path, hunks, added, removed).  Lines before the first file don't count."""
    one = lambda line, what: F.rlike(line, F.lit(what)).cast("int")
    start = F.array().cast("array<struct<path:string,hunks:int,added:int,removed:int>>")

    def step(acc: Column, line: Column) -> Column:
        path = strip(F.regexp_extract(line, PATCH_FILE, 2))
        n = F.size(acc)
        last = F.get(acc, n - 1)
        hunk, plus, minus = one(line, "^@@"), one(line, r"^\+(?!\+\+)"), one(line, "^-(?!--)")
        more = F.struct(last["path"].alias("path"), (last["hunks"] + hunk).alias("hunks"), (last["added"] + plus).alias("added"), (last["removed"] + minus).alias("removed"))
        fresh = F.struct(path.alias("path"), F.lit(0).alias("hunks"), F.lit(0).alias("added"), F.lit(0).alias("removed"))
        return (
            F.when(F.rlike(line, F.lit(PATCH_FILE)), F.concat(acc, F.array(fresh)))
            .when((n > 0) & (hunk + plus + minus > 0), F.concat(F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(more)))
            .otherwise(acc)
        )

    blocks = F.aggregate(lines(c), start, step)
    total = lambda path, of: F.aggregate(F.filter(blocks, lambda b: b["path"] == path), F.lit(0), lambda a, b: a + b[of])
    names = F.array_distinct(F.transform(blocks, lambda b: b["path"]))
    return F.transform(names, lambda p: F.struct(p.alias("path"), *[total(p, of).alias(of) for of in ("hunks", "added", "removed")]))


def shell_argument(c: Column, limit: int = 600) -> Column:
    """A text on one line, with stand-ins for the characters that a command line gives a meaning."""
    flat = strip(F.regexp_replace(text_of(c), f"{SPACE}+", " "))
    safe = F.translate(flat, SHELL_CHARACTERS, SHELL_STAND_INS)
    return F.when(F.length(safe) <= limit, safe).otherwise(F.concat(F.left(safe, F.lit(limit - 1)), F.lit("…")))


def decoded_folder(c: Column) -> Column:
    """The path that a folder name made from one stands for, as far as it can be told; null for an empty name."""
    drive = F.concat(F.left(c, F.lit(1)), F.lit(":\\"), F.translate(F.substring(c, F.lit(4), F.length(c)), "-", "\\"))
    return F.nullif(F.when(F.rlike(c, F.lit(r"^\p{L}--")), drive).otherwise(c), F.lit(""))


def decoded_workspace(c: Column) -> Column:
    path = F.translate(F.substring(c, F.lit(3), F.length(c)), "-", "\\")
    drive = F.concat(F.upper(F.left(c, F.lit(1))), F.lit(":\\"), path)
    return F.nullif(F.when(F.rlike(c, F.lit(r"^\p{L}-.")), drive).otherwise(F.translate(c, "-", "\\")), F.lit(""))


def human_size(c: Column) -> Column:
    """Bytes in the largest unit that leaves 1 or more, up to GB."""
    out = F.format_string("%.1f GB", c / float(1 << 30))
    for unit, power in (("MB", 20), ("KB", 10)):
        out = F.when(c < 1 << (power + 10), F.format_string(f"%.1f {unit}", c / float(1 << power))).otherwise(out)
    return F.when(c < 1024, F.concat(c.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def local_label(ts: Column, zone: str) -> Column:
    """A UTC time as date and minute in a zone, `-` for a null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm"), F.lit("-"))


def title_of(c: Column, limit: int = 80) -> Column:
    """The first line that says something, else the whole text on one line, or null."""
    bare = F.transform(lines(c), lambda x: strip(F.regexp_replace(strip(x), "^#+", "")))
    telling = F.filter(bare, lambda x: (F.length(x) >= 2) & ~F.startswith(x, F.lit("```")) & ~F.rlike(x, F.lit(any_of(TITLE_NOISE))))
    return F.nullif(truncate(F.coalesce(F.get(telling, F.lit(0)), collapse(c)), limit), F.lit(""))


def filled(template: str, *values: Column) -> Column:
    """A template with each `{}` replaced by a value."""
    parts = template.split("{}")
    return reduce(lambda out, x: F.concat(out, x[0].cast("string"), F.lit(x[1])), zip(values, parts[1:]), F.lit(parts[0]))


def epoch_time(c: Column) -> Column:
    """Seconds or, beyond 10 ** 12, milliseconds since the epoch, as a timestamp."""
    return F.when(F.abs(c) > 1_000_000_000_000, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c))


def signed(c: Column) -> Column:
    return F.format_string("%+d", c)


def json_object(c: Column) -> Column:
    """The JSON object that a text is, fences aside, or else the one from its first to its last brace, as a variant, or null."""
    bare = strip(F.regexp_replace(text_of(c), "(?m)^```[a-zA-Z]*[ \t]*$", ""))
    tried = F.coalesce(F.try_parse_json(bare), F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))))
    return F.when(F.startswith(F.schema_of_variant(tried), F.lit("OBJECT")), tried)


def start_failure(errors: Column) -> Column:
    """One sentence for the errors of several tries, each `way: reason`: the common reason and their number, or all of them."""
    reason = lambda e: F.when(F.contains(e, F.lit(": ")), F.substring(e, F.instr(e, F.lit(": ")) + 2, F.length(e))).otherwise("")
    reasons = F.array_distinct(F.transform(errors, reason))
    same = filled(LABEL["start_same"], F.get(reasons, F.lit(0)), F.size(errors))
    each = F.concat(F.lit(LABEL["start_each"]), F.array_join(errors, "；"))
    return F.when(F.size(errors) > 0, F.when(F.size(reasons) == 1, same).otherwise(each)).otherwise(LABEL["start_unknown"])


def upsert_section(document: Column, section: Column, begin: str, end: str) -> Column:
    """The document with the text between the markers replaced, or appended where it has none.  Doing so twice changes nothing."""
    d = text_of(document)
    block = F.concat(F.lit(begin + "\n"), section, F.lit("\n" + end))
    has = F.contains(d, F.lit(begin)) & F.contains(d, F.lit(end))
    head = F.substring_index(d, begin, 1)
    tail = F.substring(d, F.instr(d, F.lit(end)) + len(end), F.length(d))
    return F.when(has, F.concat(head, block, tail)).when(d == "", block).otherwise(F.concat(F.regexp_replace(d, "\n+$", ""), F.lit("\n\n"), block))
