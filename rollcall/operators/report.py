"""The explanation report: what was merged, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import tasks


def summary(clusters: DataFrame) -> DataFrame:
    """(total_profiles, clusters_with_merges); zeros for no clusters."""
    sizes = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("total_profiles"), F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("clusters_with_merges"))


def candidates(profiles: DataFrame, clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster_id, candidate_id, full_name, overall_confidence, merge_explanation{merged, record_count, match_details[]}).

    ``scores``: scored pairs; those that match explain the merge of their cluster.
    """
    n = tasks(clusters)
    sizes = clusters.repartition(n, "cluster_id").groupBy("cluster_id").agg(F.count("*").alias("n"))
    detail = F.struct("seq_a", "seq_b", "total_score", F.transform("signals", lambda s: s["details"]).alias("explanation"))
    matches = scores.where("is_match").join(clusters.withColumnRenamed("seq", "seq_a").repartition(n, "seq_a"), "seq_a")
    details = matches.repartition(n, "cluster_id").groupBy("cluster_id").agg(F.sort_array(F.collect_list(detail)).alias("match_details"))
    none = F.array().cast("array<struct<seq_a:bigint,seq_b:bigint,total_score:double,explanation:array<string>>>")
    merge = F.struct((F.col("n") > 1).alias("merged"), F.col("n").alias("record_count"), F.coalesce("match_details", none).alias("match_details"))
    return profiles.repartition(n, "cluster_id").join(sizes, "cluster_id").join(details, "cluster_id", "left").select("cluster_id", "candidate_id", "full_name", "overall_confidence", merge.alias("merge_explanation"))


def reasons(indent: str = "  • ") -> Column:
    lines = F.flatten(F.transform("merge_explanation.match_details", lambda d: d["explanation"]))
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(indent), x)), "\n")


def candidate_text(rows: DataFrame) -> DataFrame:
    """(candidate_id, text) of each candidate's own report."""
    bar = "=" * 60
    merged = F.when(F.col("merge_explanation.merged"), F.concat(F.lit("\nMerge Reason:\n"), reasons())).otherwise("")
    head = F.format_string(f"{bar}\nCANDIDATE EXPLAINABILITY REPORT\n{bar}\nCandidate: %s\nID: %s\nConfidence: %.4f", F.coalesce("full_name", F.lit("Unknown")), "candidate_id", "overall_confidence")
    return rows.select("candidate_id", F.concat(head, merged, F.lit("\n")).alias("text"))


def run_text(rows: DataFrame, total: DataFrame) -> DataFrame:
    """(part, at, text): the whole run's report as lines of a text file, in order of ``part`` and ``at``."""
    bar = "=" * 70
    head = total.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.format_string(f"CANDIDATE EXPLAINABILITY REPORT\n{bar}\n\nTotal Profiles: %d\nClusters with Merges: %d\n", "total_profiles", "clusters_with_merges").alias("text"))
    merged = F.when(F.col("merge_explanation.merged"), F.concat(F.lit("\nMerge Reason:\n"), reasons())).otherwise("")
    body = rows.select(F.lit(1).alias("part"), F.col("cluster_id").alias("at"), F.concat(F.format_string("-" * 50 + "\nCandidate: %s\nConfidence: %.4f", F.coalesce("full_name", F.lit("Unknown")), "overall_confidence"), merged, F.lit("\n")).alias("text"))
    end = total.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("at"), F.lit(f"{bar}\nEND OF REPORT").alias("text"))
    return head.union(body).union(end)
