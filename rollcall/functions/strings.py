"""Small string expressions that the others share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of an expression that is evaluated once, however often ``body`` names it."""
    return F.transform(F.array(x), body)[0]


def exploded(df: DataFrame, *columns: Column | str, **of: Column) -> DataFrame:
    """``columns`` and one row for each element of the list ``of``, whose elements are not null.

    Not by ``explode``: the filters that the optimizer puts before it evaluate the list once more each.
    """
    ((name, xs),) = of.items()
    return df.select(*columns, F.explode_outer(xs).alias(name)).where(F.col(name).isNotNull())


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Stripped, with runs of white space as one blank."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def blank_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def title_case(x: Column) -> Column:
    """A capital after every non-letter: new-york -> New-York, o'brien -> O'Brien."""
    return F.array_join(F.transform(F.split(F.lower(x), r"(?<=[^\p{L}])"), F.initcap), "")


def clean_list(xs: Column) -> Column:
    """Stripped elements without null and blank ones; empty for null."""
    return F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), strip), lambda x: x.isNotNull() & (x != ""))


def format_bytes(n: Column) -> Column:
    """A size as text: 0 Bytes, 1 KB, 1.5 MB; 1024 of a unit make the next, GB is the last. Null for null and negative sizes."""
    unit = sum((n >= 1024**i).cast("int") for i in (1, 2, 3))
    amount = F.regexp_replace(F.round(n / F.pow(F.lit(1024.0), unit), 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    return F.when(n == 0, "0 Bytes").when(n > 0, F.concat_ws(" ", amount, F.element_at(F.array(*map(F.lit, ["Bytes", "KB", "MB", "GB"])), unit + 1)))
