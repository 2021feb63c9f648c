"""A whole run: ingest, resolve, merge, score, shape and explain."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import confidence, merge, projection, report, resolve
from ..shared import materialise
from ..sources.ingest import ingest
from ..sources.remote import Transport


@dataclass
class Result:
    """Lazy tables of a run. Records, clusters and profiles are materialised, as several outputs read them."""

    records: DataFrame
    clusters: DataFrame
    scores: DataFrame
    profiles: DataFrame
    provenance: DataFrame
    output: DataFrame
    candidates: DataFrame
    summary: DataFrame


def resolve_records(records: DataFrame, config: Config | None = None, output: dict[str, Any] | None = None) -> Result:
    """A run over raw records."""
    config = config or Config()
    records = materialise(records)
    feats, pairs = resolve.candidate_pairs(records, config)
    clusters = materialise(resolve.cluster(records, config, candidates=(feats, pairs)))
    scores = resolve.score_pairs(pairs, feats, config, stars=resolve.every_pair_matches(config))
    profiles, provenance = merge.merge(records, clusters, config)
    provenance = materialise(provenance)
    profiles = materialise(confidence.score_profiles(profiles, provenance))
    return Result(
        records, clusters, scores, profiles, provenance, projection.project(profiles.orderBy("cluster_id"), output, provenance),
        report.candidates(profiles, clusters, scores), report.summary(clusters),
    )


def run(spark: SparkSession, paths: list[str], config: Config | None = None, output: dict[str, Any] | None = None, transport: Transport | None = None) -> Result:
    """A run over files, folders and URLs. No sources give empty tables."""
    return resolve_records(ingest(spark, paths, config, transport), config, output)
