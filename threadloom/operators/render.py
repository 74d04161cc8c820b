"""State documents as texts: Markdown, a context within a budget, the first prompt, and what a writer of patches is told.

A text is an array of lines, built within the document's row; what has nothing to say gives no lines.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import PATCH_FORM, PROMPT, PROMPT_GOAL, PROMPT_OPENING, PROMPT_REQUIREMENT, RENDER, SHOWN
from ..functions import text as X
from .aggregate import SESSION
from .revise import by_priority

#: The name of what writes a text, unless another is given.
TOOL = "Threadloom"


def lines(*parts: Column | str | list[str] | None) -> Column:
    """An array of lines from strings, arrays of strings and lists; nulls are left out."""
    each = [F.array(*[F.lit(x) for x in p]) if isinstance(p, list) else F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.array_compact(F.flatten(F.array(*[F.array_compact(F.array(c)) if isinstance(p, str) else c for p, c in zip(parts, each)])))


def one(line: Column) -> Column:
    """A single line, or none where it is null."""
    return F.array_compact(F.array(line))


def some(items: Column, *parts: Column | str | list[str]) -> Column:
    """Lines that are only there if the array has any item."""
    return F.when(F.size(F.coalesce(items, F.array())) > 0, lines(*parts)).otherwise(F.array().cast("array<string>"))


def shown(kind: str, c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in SHOWN[kind].items() for x in pair])
    return F.coalesce(F.try_element_at(names, c), c)


def known(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))


def filled(name: str, *values: Column) -> Column:
    """A line of RENDER, or null where a value is."""
    return X.filled(RENDER[name], *values)


def told(c: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(c, F.lit(""))


def bullets(items: Column, title: str | None = None, empty: str = "none") -> Column:
    own = F.when(F.size(F.coalesce(items, F.array())) > 0, F.transform(items, lambda x: F.concat(F.lit("- "), x))).otherwise(F.array(F.lit(RENDER[empty])))
    return lines(*([RENDER[title], ""] if title else []), own, "")


def failed_attempts() -> Column:
    return F.filter(F.coalesce("attempts", F.array()), lambda a: ~a["success"])


def as_markdown(documents: DataFrame, now: str = "", tool: str = TOOL) -> DataFrame:
    """session_id, markdown: the document's sections in order, numbered from 1; those that have nothing to say are left out.

    now is the time that the text states.  memory_id is read from the documents if they have one.
    """
    c, cell = F.col, X.table_cell
    memory_id = c("memory_id") if "memory_id" in documents.columns else F.lit(None).cast("string")
    meta = [known(memory_id), c("metadata.source_agent"), known(c("metadata.source_session_id")), c("metadata.schema_version"), F.lit(now), known(c("task.reconstructed_by")), shown("confidence", c("task.confidence"))]
    head = lines(
        RENDER["document"], "", one(X.filled(RENDER["written_by"], F.lit(tool))), "", RENDER["meta_title"], "", RENDER["meta_head"], RENDER["meta_rule"],
        *[one(X.filled(t, F.coalesce(v, F.lit("")))) for t, v in zip(RENDER["meta"], meta)], "",
    )
    failed = failed_attempts()
    files = F.transform("implementation.modified_files", lambda f: F.concat(F.lit("| `"), f["path"], F.lit("` | "), shown("file", f["status"]), F.lit(" | "), F.coalesce(told(f["summary"]), F.lit("-")), F.lit(" |")))
    rows = F.transform(failed, lambda a, i: F.concat_ws(" | ", F.concat(F.lit("| "), (i + 1).cast("string")), cell(a["action"]), cell(a["result"]), cell(a["error"]), F.concat(cell(a["lesson"]), F.lit(" |"))))
    origin = lambda t: F.when(t["source"] == "program", RENDER["by_program"]).otherwise(RENDER["by_model"])
    tests = F.transform("validation.tests", lambda t: F.concat(F.lit("| `"), cell(t["command"]), F.lit("` | "), shown("test", t["status"]), F.lit(" | "), origin(t), F.lit(" | "), cell(t["output_summary"]), F.lit(" |")))
    lint = F.array_join(F.transform(F.slice(F.coalesce("validation.lint", F.array().cast("array<string>")), 1, 5), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), "、")
    decisions = F.flatten(F.transform("decisions", lambda d: lines(one(F.concat(F.lit("- **"), d["decision"], F.lit("**"))), one(X.filled(RENDER["decision_reason"], told(d["reason"]))))))
    issues = F.flatten(F.transform("unresolved", lambda i: lines(one(filled("issue", shown("priority", i["priority"]), i["description"])), one(filled("issue_cause", told(i["suspected_cause"]))), one(filled("issue_context", told(i["context"]))))))
    steps = by_priority(F.coalesce("next_actions", F.array().cast(documents.schema["next_actions"].dataType)))
    actions = F.flatten(F.transform(steps, lambda a: lines(one(F.concat(a["priority"].cast("string"), F.lit(". "), a["action"])), one(filled("action_reason", told(a["reason"]))))))
    risks = F.flatten(F.transform("risks", lambda r: lines(one(F.concat(F.lit("- **"), r["description"], F.lit("**"))), one(filled("risk_impact", told(r["impact"]))), one(filled("risk_mitigation", told(r["mitigation"]))))))
    changed = F.transform(F.slice("git.changed_files", 1, 12), lambda f: F.concat(F.lit("`"), f, F.lit("`")))
    state = F.coalesce(told(c("git.branch")), told(c("git.status_summary"))).isNotNull()
    diff = F.when(told(c("git.diff_summary")).isNotNull(), lines(RENDER["git_diff"], one(X.truncate(c("git.diff_summary"), 3000)), RENDER["git_diff_end"])).otherwise(F.array().cast("array<string>"))
    git = F.when(
        state,
        lines(one(filled("git_at", known(c("git.branch")), known(c("git.commit")))), one(filled("git_status", known(c("git.status_summary")))), some(c("git.changed_files"), one(filled("git_files", F.size("git.changed_files"), F.array_join(changed, "、")))), diff),
    ).otherwise(F.array(F.lit(RENDER["no_git"])))
    commands = F.transform(F.slice(c("runtime.recent_commands"), F.greatest(F.size("runtime.recent_commands") - 7, F.lit(1)), 8), lambda x: X.filled(RENDER["command"], X.truncate(x, 160)))
    either = lambda items, full, empty: F.when(F.size(F.coalesce(items, F.array())) > 0, full).otherwise(F.array(F.lit(RENDER[empty])))
    build = F.when(c("validation.build").isNotNull(), filled("build", c("validation.build.status"), known(c("validation.build.command")))).otherwise(RENDER["no_build"])
    bodies = [
        ("task", lines(*[one(filled(f, known(v))) for f, v in (("title", c("task.title")), ("status", shown("status", c("task.status"))), ("goal", c("task.goal")))], one(filled("background", told(c("task.background")))), "", bullets(c("task.requirements"), "requirements"), bullets(c("task.constraints"), "constraints"))),
        ("done", lines(bullets(c("implementation.completed"), empty="nothing_done"), some(files, RENDER["files"], "", RENDER["files_head"], RENDER["files_rule"], files, ""), *[some(c(f"implementation.{n}_files"), bullets(c(f"implementation.{n}_files"), n)) for n in ("created", "deleted")])),
        ("decisions", lines(either(c("decisions"), lines(RENDER["decided"], "", decisions), "no_decisions"), "")),
        ("failed", lines(either(failed, lines(RENDER["failed"], "", RENDER["failed_head"], RENDER["failed_rule"], rows), "no_failed"), "")),
        ("checks", lines(either(tests, lines(RENDER["tests_head"], RENDER["tests_rule"], tests, ""), "no_tests"), one(build), one(F.when(lint != "", filled("lint", lint))), "")),
        ("open", lines(either(c("unresolved"), issues, "no_open"), "")),
        ("next", lines(either(steps, actions, "no_next"), "")),
        ("risks", F.when(F.size(F.coalesce("risks", F.array())) > 0, lines(risks, ""))),
        ("git", lines(git, "", RENDER["git_note"], "")),
        ("runtime", F.when(told(c("runtime.working_directory")).isNotNull(), lines(one(filled("folder", c("runtime.working_directory"))), one(filled("system", known(c("runtime.operating_system")))), one(filled("shell", known(c("runtime.shell")))), some(c("runtime.recent_commands"), RENDER["commands"], commands), ""))),
        ("conflicts", lines(RENDER["conflicts"], "")),
    ]
    parts = F.array_compact(F.array(*[F.when(body.isNotNull(), F.struct(F.lit(RENDER[f"{name}_title"]).alias("title"), body.alias("body"))) for name, body in bodies]))
    numbered = F.flatten(F.transform(parts, lambda p, i: lines(one(F.concat(F.lit("## "), (i + 1).cast("string"), F.lit(". "), p["title"])), "", p["body"])))
    return documents.select(SESSION, F.array_join(F.concat(head, numbered), "\n").alias("markdown"))


def initial_prompt(documents: DataFrame, reference: str) -> DataFrame:
    """session_id, prompt: how the next one is to go on, with the goal and where the document lies."""
    goal = X.truncate(F.col("task.goal"), 600)
    text = lines(PROMPT_OPENING, "", RENDER["read"].format(reference), "", PROMPT_GOAL, "", one(goal), "", PROMPT_REQUIREMENT, "", RENDER["rules"], "")
    return documents.select(SESSION, F.array_join(text, "\n").alias("prompt"))


def packed(chunks: Column, budget: int, used: int = 0) -> Column:
    """Of chunks, an array of (size, lines) by weight, those that fit: struct(used, kept).  One that would pass the budget is left out, later ones may still fit."""
    start = F.struct(F.lit(used).alias("used"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, chunk: Column) -> Column:
        size = acc["used"] + chunk["size"]
        return F.struct(F.when(size <= budget, size).otherwise(acc["used"]).alias("used"), F.when(size <= budget, F.concat(acc["kept"], chunk["lines"])).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(chunks, start, step)


def inline_context(documents: DataFrame, reference: str, marker: str = "threadloom", budget: int = 2600, tool: str = TOOL) -> DataFrame:
    """session_id, context: the document in brief, between two marks.

    Blocks go by weight; one that would pass the budget, head and foot included, is left out, later ones may still fit.
    """
    none = F.array().cast("array<string>")
    short = lambda items, n, f: F.transform(F.slice(F.coalesce(items, F.array()), 1, n), f)
    line = lambda c, n: F.concat(F.lit("- "), X.clip(c, n))
    why = lambda a: X.clip(F.coalesce(told(a["error"]), a["result"]), 140)
    tried = lambda a: F.concat(filled("context_tried", X.clip(a["action"], 130)), F.coalesce(filled("context_why", told(why(a))), F.lit("")))
    path = filled("context_project", told(F.col("project.path")))
    steps = by_priority(F.coalesce("next_actions", F.array().cast(documents.schema["next_actions"].dataType)))
    blocks = [
        ("task", lines(one(filled("context_goal", X.clip(F.col("task.goal"), 300))), one(filled("context_status", F.col("task.status"))), one(path))),
        ("failed", short(failed_attempts(), 5, tried)),
        ("open", short(F.col("unresolved"), 4, lambda i: line(i["description"], 160))),
        ("next", short(steps, 4, lambda a: line(a["action"], 170))),
        ("done", short(F.col("implementation.completed"), 4, lambda x: line(x, 150))),
        ("decided", short(F.col("decisions"), 3, lambda d: line(d["decision"], 150))),
    ]
    head = [f"<!-- {marker}:begin -->", *[x.format(tool) for x in RENDER["context_head"]]]
    tail = [*[x.format(reference) for x in RENDER["context_tail"]], f"<!-- {marker}:end -->"]
    chunks = F.array_compact(F.array(*[F.when(F.size(F.coalesce(b, none)) > 0, lines(f"## {RENDER[f'context_{t}']}", "", b, "")) for t, b in blocks]))
    rows = documents.withColumn("chunks", F.transform(chunks, lambda c: F.struct(F.length(F.array_join(c, "\n")).alias("size"), c.alias("lines"))))
    kept = packed(F.col("chunks"), budget, len("\n".join(head + tail)))["kept"]
    return rows.select(SESSION, F.array_join(lines(head, kept, tail), "\n").alias("context"))


def prompt_text(bundles: DataFrame, documents: DataFrame, most: int = 60_000, facts: DataFrame | None = None) -> DataFrame:
    """session_id, prompt: the facts of a session and its digest, for a writer of patches, and the form of a patch.

    Of a digest the first `most` characters are told, of a diff's summary 2000.  facts(session_id, facts) adds a text of its own.
    """
    rows = bundles.select(SESSION, "digest").join(documents.select(SESSION, "metadata", "project", "git"), SESSION, "left")
    rows = rows.join(facts.select(SESSION, "facts"), SESSION, "left") if facts is not None else rows.withColumn("facts", F.lit(None).cast("string"))
    p = lambda f: F.col(f"project.{f}")
    listed = lambda f: known(F.array_join(p(f), ", "))
    git = F.concat(X.filled(PROMPT["git"], *[known(F.col(f"git.{f}")) for f in ("branch", "commit", "status_summary")]), F.coalesce(X.filled(PROMPT["diff"], told(F.left("git.diff_summary", F.lit(2000)))), F.lit("")))
    parts = lines(
        one(X.filled(PROMPT["source"], F.coalesce("metadata.source_agent", F.lit("")), known(F.col(SESSION)))),
        one(X.filled(PROMPT["project"], known(p("path")), known(p("name")), listed("language"), listed("framework"), known(p("structure_summary")))),
        one(git), one(X.filled(PROMPT["digest"], F.left("digest", F.lit(most)))), one(X.filled(PROMPT["facts"], told(F.col("facts")))),
        PROMPT["contract"].format(json.dumps(PATCH_FORM, ensure_ascii=False, indent=2)),
    )
    return rows.select(SESSION, F.array_join(parts, "\n\n").alias("prompt"))
