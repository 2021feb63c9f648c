"""Phone numbers in E.164 form."""

from __future__ import annotations

from functools import cache
from importlib import import_module
from importlib.util import find_spec
from types import ModuleType

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import clean_list, strip

# Calling codes of the regions whose ten-digit numbers are national ones.
CALLING_CODES = {"IN": "91", "US": "1"}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def normalize_phone(phone: Column, region: str = "IN") -> Column:
    """+digits; null under seven digits, or under ten without a plus sign."""
    x, d = strip(phone), digits(phone)
    n = F.length(d)
    out = F.when(n < 7, None).when(x.startswith("+"), F.concat(F.lit("+"), d))
    if region in CALLING_CODES:
        out = out.when(n == 10, F.concat(F.lit("+" + CALLING_CODES[region]), d))
    return out.when(n >= 10, F.concat(F.lit("+"), d))


@cache
def has_library() -> bool:
    """Whether the driver can import the phonenumbers package; executors must have it then as well."""
    return find_spec("phonenumbers") is not None


def parsed_e164(library: ModuleType, phone: str, region: str) -> str | None:
    """By the phonenumbers package: E.164 of a number that is at least possible; the region counts without a plus sign."""
    try:
        number = library.parse(phone, None if phone.startswith("+") else region)
    except library.NumberParseException:
        return None
    return library.format_number(number, library.PhoneNumberFormat.E164) if library.is_possible_number(number) else None


def normalize_phones(numbers: Column, region: str = "IN") -> Column:
    """The normal forms of a list's numbers, in order, without those that have none; an empty list for null.

    The phonenumbers package decides where it is installed, ``normalize_phone`` elsewhere.
    """
    given = clean_list(numbers)
    if not has_library():
        return F.filter(F.transform(given, lambda p: normalize_phone(p, region)), lambda p: p.isNotNull())

    @F.pandas_udf("array<string>")
    def by_library(lists: pd.Series) -> pd.Series:
        library = import_module("phonenumbers")
        return lists.map(lambda xs: [y for x in xs if (y := parsed_e164(library, x, region)) is not None])

    return by_library(given)
