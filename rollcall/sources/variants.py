"""Reading loosely typed JSON: present-but-null is told from missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import strip


def at(v: Column, key: str) -> Column:
    """The member as a variant: null if missing, a variant null if null."""
    return F.try_variant_get(v, f"$['{key}']" if not key.isidentifier() else f"$.{key}", "variant")


def real(v: Column) -> Column:
    """SQL null for a variant null."""
    return F.when(~F.is_variant_null(v), v)


def present(v: Column, *keys: str) -> Column:
    """The first member that is there, even as null."""
    return F.coalesce(*(at(v, k) for k in keys))


def given(v: Column, *keys: str) -> Column:
    """The first member that is there and not null."""
    return F.coalesce(*(real(at(v, k)) for k in keys))


def kind(v: Column) -> Column:
    return F.schema_of_variant(real(v))


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_list(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("ARRAY"), F.lit(False))


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def text(v: Column) -> Column:
    """A scalar as text; null for objects, lists and null."""
    return F.try_variant_get(v, "$", "string")


def only_text(v: Column) -> Column:
    """A string's text; null for anything else."""
    return F.when(is_text(v), text(v))


def number(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "double"), text(v).try_cast("double"))


def truthy(v: Column) -> Column:
    """Neither missing, null, false, zero nor empty."""
    json = F.to_json(real(v))
    return F.coalesce(~json.isin('""', "false", "0", "0.0", "[]", "{}"), F.lit(False))


def elements(v: Column) -> Column:
    """A list's elements as variants; empty for anything else."""
    return F.coalesce(F.when(is_list(v), F.try_variant_get(v, "$", "array<variant>")), F.expr("array()").cast("array<variant>"))


def text_list(v: Column) -> Column:
    """A string as a list of one, a list's scalars as texts without null and empty ones; empty for anything else."""
    return (
        F.when(is_list(v), F.filter(F.transform(elements(v), text), lambda x: x.isNotNull() & (x != "")))
        .when(is_object(v), F.array().cast("array<string>"))
        .otherwise(F.filter(F.array(text(v)), lambda x: x.isNotNull() & (x != "")))
    )


def first_text(*values: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*(F.when(x != "", x) for x in values))


def chosen_object(cases: list[Column], otherwise: Column) -> Column:
    """The first of ``cases`` that is an object."""
    return reduce(lambda out, c: F.when(is_object(c), c).otherwise(out), reversed(cases), otherwise)


def full_name(v: Column, full: list[str], first: list[str], last: list[str]) -> Column:
    """The full name, else first and last name with a blank."""
    joined = strip(F.concat_ws(" ", F.coalesce(text(present(v, *first)), F.lit("")), F.coalesce(text(present(v, *last)), F.lit(""))))
    return first_text(text(present(v, *full)), joined)
