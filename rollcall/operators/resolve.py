"""Entity resolution: blocking keys, candidate pairs, scores and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STRONG, WEIGHTS, Config
from ..functions.names import name_similarity
from ..functions.phones import normalize_phones
from ..functions.strings import clean_list, exploded, strip
from ..functions.urls import github_username, linkedin_username
from ..shared import materialise, tasks
from .components import connected_components

KEYS = ["email", "phone", "linkedin", "github"]


def features(records: DataFrame, config: Config | None = None) -> DataFrame:
    """(seq, record_id and the normalised values that keys and signals compare)."""
    config = config or Config()
    lower = lambda xs: F.array_distinct(F.transform(clean_list(xs), F.lower))
    return records.select(
        "seq", "record_id", "full_name",
        lower(F.col("emails")).alias("email"),
        F.array_distinct(normalize_phones(F.col("phones"), config.default_phone_region)).alias("phone"),
        F.lower(linkedin_username(F.col("links.linkedin"))).alias("linkedin"),
        F.lower(github_username(F.col("links.github"))).alias("github"),
        F.lower(F.coalesce(github_username(F.col("links.github")), strip(F.col("github_username")))).alias("github_any"),
        F.lower(strip(F.col("location.city"))).alias("city"),
        lower(F.transform(F.col("experience"), lambda e: e["company"])).alias("companies"),
        lower(F.transform(F.col("education"), lambda e: e["institution"])).alias("institutions"),
        lower(F.col("skills")).alias("skills"),
    )


def block_keys(feats: DataFrame) -> DataFrame:
    """(key_type, key, seq) without repeats: what puts records into the same block."""
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    tagged = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("key_type"), x.alias("key")))
    keys = F.concat(tagged("email", F.col("email")), tagged("phone", F.col("phone")), tagged("linkedin", one(F.col("linkedin"))), tagged("github", one(F.col("github"))))
    return exploded(feats, "seq", k=F.array_distinct(keys)).select("k.key_type", "k.key", "seq")


def block_pairs(keys: DataFrame, *, stars: bool = False) -> DataFrame:
    """(seq_a, seq_b), seq_a < seq_b, of records that share a key, each pair once.

    All pairs of a block grow with its square. ``stars`` pairs only each block's first record with the
    others: enough for components if every blocked pair matches.
    """
    if stars:
        first = keys.groupBy("key_type", "key").agg(F.min("seq").alias("seq_a"), F.count("*").alias("n")).where("n > 1").drop("n")
        pairs = keys.join(first, ["key_type", "key"]).where("seq_a < seq").select("seq_a", F.col("seq").alias("seq_b"))
    else:
        other = keys.withColumnRenamed("seq", "seq_b")
        pairs = keys.withColumnRenamed("seq", "seq_a").join(other, ["key_type", "key"]).where("seq_a < seq_b").select("seq_a", "seq_b")
    return pairs.distinct()


def signals(a, b, likeness: Column, config: Config) -> dict[str, tuple[Column, Column]]:
    """signal -> (whether it holds, its detail) of two feature structs and the similarity of their names."""
    shared = lambda name: F.array_sort(F.array_intersect(a[name], b[name]))
    some = lambda name: F.size(shared(name)) > 0
    joined = lambda label, xs: F.concat(F.lit(label), F.array_join(xs, ", "))
    same = lambda name: F.coalesce((a[name] == b[name]) & (a[name] != ""), F.lit(False))
    fewer = F.least(F.size(a["skills"]), F.size(b["skills"]))
    overlap = F.size(shared("skills"))
    ratio = F.when(fewer > 0, overlap / fewer).otherwise(0.0)
    return {
        "email_match": (some("email"), joined("Matching emails: ", shared("email"))),
        "phone_match": (some("phone"), joined("Matching phones: ", shared("phone"))),
        "linkedin_match": (same("linkedin"), F.concat(F.lit("Matching LinkedIn: "), a["linkedin"])),
        "github_match": (same("github_any"), F.concat(F.lit("Matching GitHub: "), a["github_any"])),
        "name_similarity": (likeness >= config.name_similarity_threshold, F.format_string("Name similarity: %.2f ('%s' vs '%s')", likeness, a["full_name"], b["full_name"])),
        "location_match": (same("city"), F.concat(F.lit("Matching city: "), a["city"])),
        "company_overlap": (some("companies"), joined("Common companies: ", shared("companies"))),
        "education_overlap": (some("institutions"), joined("Common institutions: ", shared("institutions"))),
        "skill_overlap": ((overlap > 0) & (ratio >= config.skill_overlap_threshold), F.format_string("Skill overlap: %.1f%% (%d/%d)", ratio * 100, overlap, fewer)),
    }


def score_pairs(pairs: DataFrame, feats: DataFrame, config: Config | None = None, *, stars: bool = False) -> DataFrame:
    """(seq_a, seq_b, total_score, is_match, signals[signal_type, weight, is_strong, details]) of candidate pairs.

    ``stars``: the pairs are about as many as the records, and dealt to tasks by their number; all pairs of blocks are
    dealt by their size.
    """
    config = config or Config()
    n = tasks(feats) if stars else 0
    dealt = lambda rows, key: rows.repartition(n, key) if stars else rows
    side = lambda s: feats.select(F.col("seq").alias(f"seq_{s}"), F.struct(*[c for c in feats.columns if c != "seq"]).alias(s))
    both = dealt(dealt(pairs, "seq_a").join(dealt(side("a"), "seq_a"), "seq_a"), "seq_b").join(dealt(side("b"), "seq_b"), "seq_b")
    both = both.withColumn("likeness", name_similarity(F.col("a.full_name"), F.col("b.full_name")))
    found = []
    for name, (holds, details) in signals(F.col("a"), F.col("b"), F.col("likeness"), config).items():
        weight = F.lit(float(config.weights.get(name, WEIGHTS[name])))
        found.append(F.when(holds, F.struct(F.lit(name).alias("signal_type"), weight.alias("weight"), F.lit(name in STRONG).alias("is_strong"), details.alias("details"))))
    scored = both.select("seq_a", "seq_b", F.filter(F.array(*found), lambda s: s.isNotNull()).alias("signals"))
    total = F.aggregate("signals", F.lit(0.0), lambda t, s: t + s["weight"])
    enough = F.col("total_score") >= config.merge_threshold
    if config.require_strong_signal_for_merge:
        enough &= F.exists("signals", lambda s: s["is_strong"])
    return scored.withColumn("total_score", total).select("seq_a", "seq_b", "total_score", enough.alias("is_match"), "signals")


def every_pair_matches(config: Config) -> bool:
    """Whether any shared key alone reaches the threshold, so that blocks need no pairs."""
    return min(config.weights.get(s, WEIGHTS[s]) for s in STRONG) >= config.merge_threshold


def candidate_pairs(records: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, pairs), both written, for those that cluster the records and score their pairs as well.

    Where every blocked pair matches, a record's match with the first of its block explains it; all pairs would
    grow with the block's square.
    """
    config = config or Config()
    feats = materialise(features(records, config))
    return feats, materialise(block_pairs(block_keys(feats), stars=every_pair_matches(config)))


def cluster(records: DataFrame, config: Config | None = None, *, by_pairs: bool | None = None, candidates: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seq, cluster_id): the smallest ``seq`` of the records that matches join.

    Where every blocked pair matches, a record is linked with the first of each of its blocks only, which
    keeps the work in proportion to the keys. Otherwise all pairs of a block are scored. A record without a
    match is its own cluster. ``candidates``: what ``candidate_pairs`` gave for the same records and config.
    """
    config = config or Config()
    stars = every_pair_matches(config) if by_pairs is None else not by_pairs
    if candidates:
        feats, pairs = candidates
    else:
        feats = features(records, config)
        keys = block_keys(feats)
        pairs = block_pairs(materialise(keys) if stars else keys, stars=stars)
    edges = pairs if stars else score_pairs(pairs, feats, config).where("is_match")
    parts = connected_components(records.select(F.col("seq").alias("id")), edges.select(F.col("seq_a").alias("src"), F.col("seq_b").alias("dst")))
    return parts.select(F.col("id").alias("seq"), F.col("component").alias("cluster_id"))
