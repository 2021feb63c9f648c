"""Countries as ISO 3166 alpha-2 codes."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .strings import bound, strip
from .tables import country_aliases, country_names, iso_countries, lookup, map_literal


def is_alpha2(code: Column, spark: SparkSession | None = None) -> Column:
    table = iso_countries(spark or SparkSession.active())
    return F.upper(code).isin(sorted(set(table.values())))


def normalize_country(country: Column, extra: Mapping[str, str] | None = None, spark: SparkSession | None = None) -> Column:
    """A valid two-letter code as it is, else by alias, alpha-3 code, English name or a part of it; null if unknown."""
    spark = spark or SparkSession.active()
    iso = iso_countries(spark)
    # a two-letter code goes before an alias; other entries after it
    table = iso | country_aliases(extra) | {k: v for k, v in iso.items() if len(k) == 2}
    return bound(F.lower(strip(country)), lambda x: F.coalesce(lookup(map_literal(table), x), country_with(x, spark)))


def country_with(part: Column, spark: SparkSession) -> Column:
    """The country whose lower-cased name holds ``part``: 30 points less 2 for each letter before it, 5 at least; ties by alpha-3 code."""
    table = [{"name": name, "alpha3": alpha3, "code": code} for name, alpha3, code in country_names(spark)]
    names = F.from_json(F.lit(json.dumps(table)), "array<struct<name:string,alpha3:string,code:string>>")
    points = lambda c: F.greatest(F.lit(5), F.lit(32) - F.lit(2) * F.instr(c["name"], part))
    found = F.transform(F.filter(names, lambda c: F.contains(c["name"], part)), lambda c: F.struct((-points(c)).alias("rank"), c["alpha3"].alias("alpha3"), c["code"].alias("code")))
    return F.when(part != "", F.array_min(found)["code"])
