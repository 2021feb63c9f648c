"""Person names: normal form, tokens and similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank_to_null, bound, squeeze, strip
from .tables import lookup, map_literal, nicknames

# Titles that are no part of a name.
HONORIFICS = "mr|mrs|ms|dr|prof|sir|md|phd"


def normalize_name(name: Column) -> Column:
    """Title case without honorifics and punctuation (full stops stay); null if nothing is left."""
    bare = F.regexp_replace(strip(name), rf"(?iU)\b({HONORIFICS})\b\.?", "")
    return F.initcap(blank_to_null(squeeze(F.regexp_replace(bare, r"(?U)[^\w\s.]", ""))))


def name_tokens(name: Column) -> Column:
    """Lower-cased words without trailing full stops; empty for null."""
    words = F.transform(F.split(strip(F.coalesce(name, F.lit(""))), r"(?U)\s+"), lambda t: F.lower(F.regexp_replace(t, r"\.+$", "")))
    return F.filter(words, lambda t: t != "")


def name_similarity(one: Column, other: Column, groups: list[list[str]] | None = None) -> Column:
    """0.6 * Jaccard of the tokens with their nicknames + 0.4 * share of the shorter name's tokens found in the longer's.

    Null or empty names give 0. Of equally long names, the first counts as the shorter.
    """
    table = map_literal(nicknames(groups))
    same = lambda t: F.coalesce(lookup(table, t), F.array(t))
    widened = lambda tokens: F.array_distinct(F.flatten(F.transform(tokens, same)))

    def compared(x: Column) -> Column:
        a, b, wide_a, wide_b = x["a"], x["b"], x["wide_a"], x["wide_b"]
        jaccard = F.size(F.array_intersect(wide_a, wide_b)) / F.size(F.array_union(wide_a, wide_b))
        first = F.size(a) <= F.size(b)
        shorter, longer = F.when(first, a).otherwise(b), F.when(first, wide_b).otherwise(wide_a)
        covered = F.size(F.filter(shorter, lambda t: F.arrays_overlap(same(t), longer))) / F.size(shorter)
        return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(0.6 * jaccard + 0.4 * covered)

    tokens = F.struct(name_tokens(one).alias("a"), name_tokens(other).alias("b"))
    wide = lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), widened(x["a"]).alias("wide_a"), widened(x["b"]).alias("wide_b"))
    return bound(bound(tokens, wide), compared)


def names_compatible(one: Column, other: Column, threshold: float = 0.85, groups: list[list[str]] | None = None) -> Column:
    return name_similarity(one, other, groups) >= threshold
