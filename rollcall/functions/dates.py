"""Dates as YYYY-MM, YYYY or 'present'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import bound, strip
from .tables import lookup, map_literal, months

# What stands for an open end.
PRESENT = ["present", "current", "now", "ongoing", "till date", "to date"]

#: Shapes with the group of the year and of the month; of shapes that match, the first decides.
SHAPES = [
    (r"^([A-Za-z]+)(?:\s+|-)(\d{4})$", 2, 1),
    (r"^(\d{4})\s+([A-Za-z]+)$", 1, 2),
    (r"^(\d{4})[-/](\d{1,2})$", 1, 2),
    (r"^(\d{4})-(\d{1,2})-\d{1,2}$", 1, 2),
    (r"^(\d{1,2})[-/](\d{4})$", 2, 1),
    (r"^(\d{1,2})/\d{1,2}/(\d{4})$", 2, 1),
    (r"^(\d{4})$", 1, 0),
]


def resolve_month(month: Column) -> Column:
    """Two digits of a name, an abbreviation or a number from 1 to 12; else null."""
    number = F.when(month.rlike(r"^\d{1,2}$"), month).cast("int")
    name = lookup(map_literal(months()), F.lower(F.regexp_replace(month, r"^\.+|\.+$", "")))
    return F.coalesce(name, F.when(number.between(1, 12), F.lpad(number.cast("string"), 2, "0")))


def normalize_date(date: Column) -> Column:
    """Normal form of a date in any of SHAPES.

    A number that is no month leaves the year; a word that is none, a year outside 1900 to 2100, and anything else give null.
    """
    return bound(strip(date), _shaped)


def _shaped(x: Column) -> Column:
    out = F.when(F.lower(x).isin(PRESENT), F.lit("present"))
    for shape, y, m in SHAPES:
        year = F.regexp_extract(x, shape, y)
        value = year
        if m:
            month = F.regexp_extract(x, shape, m)
            value = F.coalesce(F.concat(year, F.lit("-"), resolve_month(month)), F.when(month.rlike(r"^\d"), year))
        out = out.when(x.rlike(shape), F.when(year.between("1900", "2100"), value))
    return out
