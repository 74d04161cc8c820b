"""Reading of schemaless JSON values: each takes a variant column and a path, and gives null where there is something else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("OBJECT")), F.lit(False))


def is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(kind_of(v), F.lit("ARRAY")), F.lit(False))


def string(v: Column, path: str = "$") -> Column:
    """The string there; null for a number or an object."""
    return F.when(kind_of(at(v, path)) == "STRING", at(v, path, "string"))


def filled(v: Column, path: str) -> Column:
    """The string there, unless it is empty."""
    return F.nullif(string(v, path), F.lit(""))


def items(v: Column, path: str = "$") -> Column:
    """The elements of the array there, or an empty array."""
    return F.coalesce(F.when(is_array(at(v, path)), at(v, path, "array<variant>")), F.array().cast("array<variant>"))


def truthy(v: Column, path: str) -> Column:
    """Whether there is a value other than null, false, zero and nothing."""
    x = at(v, path)
    return F.coalesce(
        F.when(kind_of(x) == "BOOLEAN", at(v, path, "boolean"))
        .when(kind_of(x) == "VOID", False)
        .when(kind_of(x) == "STRING", at(v, path, "string") != "")
        .otherwise(F.coalesce(at(v, path, "double") != 0, x.isNotNull())),
        F.lit(False),
    )


def texts(v: Column, path: str, plain: bool = True) -> Column:
    """The texts of the blocks in an array: of strings (if `plain`) and of the `text` of objects."""
    text = lambda b: F.nullif(string(b, "$.text"), F.lit(""))
    each = F.transform(items(v, path), lambda b: F.coalesce(string(b), text(b)) if plain else text(b))
    return F.filter(each, lambda t: t.isNotNull())


def joined(v: Column, path: str) -> Column:
    """A string as it is, or the texts of an array's blocks on lines of their own; an empty text for anything else."""
    return F.coalesce(string(v, path), F.array_join(texts(v, path), "\n"))


def arguments(v: Column) -> Column:
    """The object that the arguments of a call are, or that their text holds; else null."""
    parsed = F.coalesce(F.try_parse_json(string(v)), v)
    return F.when(is_object(parsed), parsed)


def first_filled(v: Column, keys: list[str], strip) -> Column:
    """The first of the named strings that isn't blank, stripped, or null."""
    return F.coalesce(*[F.nullif(strip(string(v, f"$.{k}")), F.lit("")) for k in keys])


def all_filled(v: Column, keys: list[str], strip) -> Column:
    return F.array_compact(F.array(*[F.nullif(strip(string(v, f"$.{k}")), F.lit("")) for k in keys]))
