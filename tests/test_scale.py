"""Rows are dealt to tasks by their number, and lists are evaluated once."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rollcall.operators import confidence, merge, projection, resolve
from rollcall.plans import queries
from rollcall.schema import PROFILE, conform
from rollcall.shared import LEAST_ROWS, TASK_ROWS, tasks

ROWS = 3 * TASK_ROWS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A customer table of one row group, which Spark can't split."""
    path = tmp_path_factory.mktemp("people")
    pq.write_table(pa.table({"c_custkey": pa.array(range(1, ROWS + 1), pa.int64())}), path / "customer.parquet", row_group_size=ROWS)
    return str(path)


def test_tasks_follow_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [tasks(spark.range(n)) for n in (0, 1, LEAST_ROWS, TASK_ROWS * 2 * cores, TASK_ROWS * 2 * cores + 1)] == [1, 1, 1, 2 * cores, 2 * cores + 1]


def test_people_of_one_row_group_are_many_tasks(spark, folder):
    assert queries.people(spark, folder).rdd.getNumPartitions() >= 3
    assert queries.resume_text_records(spark, folder).rdd.getNumPartitions() >= 3
    assert queries.people(spark, folder).count() == ROWS


def test_merging_is_dealt_by_records(spark, folder):
    r = queries.records(spark, folder).coalesce(1)
    clusters = spark.range(1, ROWS + 1, 1, 1).select(F.col("id").alias("seq"), F.col("id").alias("cluster_id"))
    assert merge.prepared(r, clusters, queries.Config()).rdd.getNumPartitions() >= 3


def test_tables_of_merging_are_files_by_records(spark, folder, monkeypatch):
    """Spark packs files into tasks by bytes, so that a file's records bound those of a task that reads a written table."""
    files = []

    def counted(df, f=merge.materialise):
        written = f(df)
        files.append(len(written.inputFiles()))
        return written

    monkeypatch.setattr(merge, "materialise", counted)
    r = queries.records(spark, folder).coalesce(1)
    clusters = spark.range(1, ROWS + 1, 1, 1).select(F.col("id").alias("seq"), F.col("id").alias("cluster_id"))
    p, _ = merge.merge(r, clusters)
    assert p.count() == ROWS and len(files) == 4 and min(files) >= 3


def test_keys_are_evaluated_once(spark, folder):
    feats = resolve.features(queries.records(spark, folder))
    plan = resolve.block_keys(feats)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" in plan and "size(" not in plan


def test_texts_of_provenance(spark):
    values = ['"a"', '""', '"a\\"b"', '"\\u00e9 é"', '"a\\\\"', "9.0", "null", "true", '{"a":1}', "[1]", "no json", '"', '"a" "b"', None]
    log = spark.createDataFrame([("c", (0, i, 0), "f", v, "s", "p", "m", 0.5) for i, v in enumerate(values)], "candidate_id string, ord struct<step:int,seq:bigint,pos:int>, field string, value string, source string, source_path string, method string, confidence double")
    rows = projection.project(spark.createDataFrame([("c",)], "candidate_id string"), {"include_provenance": True}, log).first()["_provenance"]
    slow = {r.value: r.plain for r in log.select("value", F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "string"), "value").alias("plain")).collect()}
    assert [r.value for r in rows] == [slow[v] for v in values]
    assert [r.value for r in rows[:3]] == [json.loads(v) for v in values[:3]]


LOG = [
    ("c", "full_name", "pdf", 0.95), ("c", "skills.Go", "pdf", 0.5), ("c", "skills.SQL", "github", 0.8), ("c", "skills.Go", "pdf", 0.7), ("c", "links.github", None, 0.95), ("c", "other", "csv", 0.4), ("c", "emails", "pdf", None), ("c", "emails", "csv", 0.95),
    ("d", "phones", None, None),
]


def test_confidence_reads_provenance_once(spark):
    log = spark.createDataFrame(LOG, "candidate_id string, field string, source string, confidence double")
    rows = [("c", ["a@b"]), ("c", []), ("d", None), ("e", ["x@y"]), (None, [])]
    profiles = conform(spark.createDataFrame(rows, "candidate_id string, emails array<string>"), PROFILE)
    scored = confidence.score_profiles(profiles, log)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "Expand" not in plan
    fields = {(r.candidate_id, r.field): float(r.confidence) for r in confidence.field_confidences(log).collect()}
    stated = confidence.with_stated(profiles, log).select("candidate_id", *(confidence.stated_confidence(F.col("stated"), k).alias(k) for k in confidence.FIELD_WEIGHTS)).distinct().collect()
    assert {(r.candidate_id, k): float(r[k]) for r in stated for k in confidence.FIELD_WEIGHTS if r[k] is not None} == fields and len(fields) == 5
    # base * coverage + bonus: (0.95*15 + 0.85*15 + 0.9*5 + 0.95*15) / 100 * 0.1 + 3 sources; d has a row that says nothing, e none
    base = sum(v * confidence.FIELD_WEIGHTS[k] for (c, k), v in fields.items() if c == "c") / 100
    assert sorted((str(r.candidate_id), r.overall_confidence) for r in scored.collect()) == sorted([("c", round(base * 0.1 + 0.15, 4)), ("c", 0.15), ("d", 0.0), ("e", 0.0), ("None", 0.0)])
    bare = confidence.breakdown(profiles.where("candidate_id = 'e'"), log).first()
    assert (bare.source_contributions, bare.total_provenance_records) == (None, 0)
    named = confidence.breakdown(profiles.where("candidate_id = 'c'"), log.where("source is not null")).first()
    assert (named.source_contributions, named.total_provenance_records, named.field_confidences["skills"]) == ({"csv": 2, "github": 1, "pdf": 4}, 7, fields["c", "skills"])


def test_reports_find_features_and_pairs_once(spark, folder, monkeypatch):
    r = queries.records(spark, folder).where("seq <= 300")
    given = resolve.candidate_pairs(r)
    plain = {(x.seq, x.cluster_id) for x in resolve.cluster(r).collect()}
    by_pairs = queries.Config(merge_threshold=130)
    scored = {(x.seq, x.cluster_id) for x in resolve.cluster(r, by_pairs).collect()}
    assert {(x.seq, x.cluster_id) for x in resolve.cluster(r, by_pairs, candidates=resolve.candidate_pairs(r, by_pairs)).collect()} == scored != plain
    calls = []
    monkeypatch.setattr(queries, "records", lambda *_: r)
    monkeypatch.setattr(resolve, "features", lambda *a, f=resolve.features: calls.append("features") or f(*a))
    monkeypatch.setattr(resolve, "block_pairs", lambda *a, f=resolve.block_pairs, **k: calls.append("pairs") or f(*a, **k))
    assert {(x.seq, x.cluster_id) for x in resolve.cluster(r, candidates=given).collect()} == plain and not calls
    assert queries.report_candidates(spark, folder).count() == len({c for _, c in plain}) and calls == ["features", "pairs"]
