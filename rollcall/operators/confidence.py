"""Confidence of fields, profiles and matches, in decimal arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CODE_SOURCE_SCORES, FIELD_WEIGHTS
from ..functions.tables import lookup, map_literal
from ..shared import tasks

DECIMAL = "decimal(18,8)"


def root(field: Column) -> Column:
    """What stands before the first dot of a row's path."""
    return F.substring_index(field, ".", 1)


def of_field(most: Column, sources: Column) -> Column:
    """The highest of a field's rows, 0.05 more for each further source, at most 1."""
    return F.round(F.least(most + F.lit("0.05").cast(DECIMAL) * (sources - 1), F.lit(1)), 4)


def field_confidences(provenance: DataFrame) -> DataFrame:
    """(candidate_id, field, confidence) of each root field."""
    field = root(F.col("field"))
    per = provenance.where(field.isin(list(FIELD_WEIGHTS))).groupBy("candidate_id", field.alias("field")).agg(F.max("confidence").cast(DECIMAL).alias("most"), F.count_distinct("source").alias("n"))
    return per.select("candidate_id", "field", of_field(F.col("most"), F.col("n")).alias("confidence"))


def with_stated(profiles: DataFrame, provenance: DataFrame) -> DataFrame:
    """``profiles`` with stated[field, source, most, n]: an entry for each root field and source of its id's rows; null without rows.

    However many rows an id has, its entries are as few as its fields times its sources. All are dealt to tasks by the
    number of profiles, which are counted, and rows once; only the entries are held for the join.
    """
    n = tasks(profiles)
    rows = provenance.select("candidate_id", root(F.col("field")).alias("field"), "source", "confidence").repartition(n, "candidate_id")
    per = rows.groupBy("candidate_id", "field", "source").agg(F.max("confidence").cast(DECIMAL).alias("most"), F.count("*").alias("n"))
    stated = per.groupBy("candidate_id").agg(F.collect_list(F.struct("field", "source", "most", "n")).alias("stated"))
    return profiles.repartition(n, "candidate_id").join(stated.hint("shuffle_hash"), "candidate_id", "left")


def stated_confidence(stated: Column, field: str) -> Column:
    """Confidence of a root field by ``with_stated``'s list; null if no row names it."""
    own = F.filter(stated, lambda x: x["field"] == field)
    sources = F.size(F.filter(own, lambda x: x["source"].isNotNull())).cast("bigint")
    return F.when(F.size(own) > 0, of_field(F.array_max(F.transform(own, lambda x: x["most"])), sources))


def coverage(p: DataFrame) -> Column:
    """Share of the ten fields that a profile has; a place needs a city or country, links need a profile."""
    filled = [
        F.col("full_name").isNotNull(), F.size("emails") > 0, F.size("phones") > 0, F.col("location.city").isNotNull() | F.col("location.country").isNotNull(),
        F.col("links.linkedin").isNotNull() | F.col("links.github").isNotNull(), F.col("headline").isNotNull(), F.col("years_experience").isNotNull(),
        F.size("skills") > 0, F.size("experience") > 0, F.size("education") > 0,
    ]
    return (reduce(Column.__add__, (F.coalesce(f, F.lit(False)).cast("int") for f in filled)) / F.lit(len(filled))).cast(DECIMAL)


def overall(base: Column, covered: Column, sources: Column) -> Column:
    """min(base * coverage + bonus, 1), the bonus 0.05 a source up to 0.15."""
    bonus = F.least(F.lit("0.05").cast(DECIMAL) * sources, F.lit("0.15").cast(DECIMAL))
    return F.least(base * covered + bonus, F.lit(1).cast(DECIMAL))


def score_profiles(profiles: DataFrame, provenance: DataFrame) -> DataFrame:
    """``profiles`` with overall_confidence."""
    both = with_stated(profiles, provenance)
    stated = F.col("stated")
    weighted = (F.coalesce((stated_confidence(stated, k) * F.lit(str(w)).cast(DECIMAL)).cast(DECIMAL), F.lit(0).cast(DECIMAL)) for k, w in FIELD_WEIGHTS.items())
    base = (reduce(Column.__add__, weighted) / sum(FIELD_WEIGHTS.values())).cast(DECIMAL)
    sources = F.size(F.array_distinct(F.filter(F.transform(stated, lambda x: x["source"]), lambda x: x.isNotNull())))
    value = overall(base, coverage(both), F.when(stated.isNotNull(), sources).otherwise(0).cast("bigint"))
    return both.withColumn("overall_confidence", F.round(value, 4).cast("double")).select(profiles.columns)


def match_confidence(total: Column, most: Column) -> Column:
    """total / most to four places, at most 1; 0 if ``most`` is not above 0."""
    return F.when(most > 0, F.least(F.round(total.cast(DECIMAL) / most.cast(DECIMAL), 4).cast("double"), F.lit(1.0))).otherwise(0.0)


def source_confidence(source: Column, scores: dict[str, float] | None = None) -> Column:
    """A source's base score, 0.40 if unknown."""
    return F.coalesce(lookup(map_literal({k: str(v) for k, v in (scores or CODE_SOURCE_SCORES).items()}), source).cast("double"), F.lit(0.40))


def breakdown(profiles: DataFrame, provenance: DataFrame) -> DataFrame:
    """(candidate_id, overall_confidence, field_confidences, coverage, source_contributions, total_provenance_records, formula)."""
    both = with_stated(profiles, provenance)
    stated = F.col("stated")
    rows = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    all_fields = F.map_from_arrays(F.array(*map(F.lit, FIELD_WEIGHTS)), F.array(*(F.coalesce(stated_confidence(stated, k).cast("double"), F.lit(0.0)) for k in FIELD_WEIGHTS)))
    names = F.sort_array(F.array_distinct(F.transform(stated, lambda x: x["source"])))
    per_source = F.map_from_entries(F.transform(names, lambda s: F.struct(s, rows(F.filter(stated, lambda x: x["source"] == s)))))
    return both.select(
        "candidate_id", "overall_confidence", all_fields.alias("field_confidences"), F.round(coverage(both), 4).cast("double").alias("coverage"), per_source.alias("source_contributions"),
        F.coalesce(rows(stated), F.lit(0)).alias("total_provenance_records"), F.lit("overall = weighted_avg(field_confidences) * coverage + multi_source_bonus (max 0.15)").alias("formula"),
    )


def tier(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.6, "medium").otherwise("low")


def dedup_rate(sources: Column, profiles: Column) -> Column:
    """Share of sources that were merged away, in per cent; 0 without sources."""
    return F.when(sources > 0, (sources - profiles) / sources * 100).otherwise(0.0)
