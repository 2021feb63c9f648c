"""Skills by taxonomy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .strings import blank_to_null, clean_list, strip
from .tables import lookup, map_literal, skill_aliases

Taxonomy = Mapping[str, list[str]] | None


def normalize_skill(skill: Column, taxonomy: Taxonomy = None) -> Column:
    """The canonical name of a known alias, else the skill itself, stripped; null if blank."""
    x = blank_to_null(strip(skill))
    return F.coalesce(lookup(map_literal(skill_aliases(taxonomy)), F.lower(x)), x)


def normalize_skills(skills: Column, taxonomy: Taxonomy = None) -> Column:
    """Canonical names of a list, the first of each (letter case aside) in order."""
    names = F.transform(clean_list(skills), lambda s: normalize_skill(s, taxonomy))
    lower = F.transform(names, F.lower)
    return F.filter(names, lambda s, i: F.array_position(lower, F.lower(s)) == i + 1)


def is_known_skill(skill: Column, taxonomy: Taxonomy = None) -> Column:
    return F.coalesce(F.map_contains_key(map_literal(skill_aliases(taxonomy)), F.lower(strip(skill))), F.lit(False))


def canonical_skills(spark: SparkSession, taxonomy: Taxonomy = None) -> DataFrame:
    """(skill) in order."""
    names = sorted(set(skill_aliases(taxonomy).values()))
    return spark.createDataFrame([(n,) for n in names], "skill string").orderBy("skill")
