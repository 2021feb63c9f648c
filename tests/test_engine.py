"""Resolution, merging, confidence, projection and report on small record sets."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from rollcall.config import Config
from rollcall.operators import confidence, merge, projection, provenance, report, resolve
from rollcall.operators.components import connected_components
from rollcall.plans.pipeline import resolve_records
from rollcall.schema import PROFILE, RECORD, ddl
from rollcall.shared import materialise


def records(spark, *rows):
    """Records from dicts; seq is the place."""
    whole = []
    for i, r in enumerate(rows):
        r = {"record_id": f"r{i}", "seq": i, "source_type": "resume_json", "source_path": f"p{i}", "emails": [], "phones": [], "skills": [], "experience": [], "education": []} | r
        whole.append(tuple(r.get(k) for k in RECORD))
    return spark.createDataFrame(whole, ddl(RECORD))


def clusters(spark, *rows, config=None, **more):
    found = resolve.cluster(records(spark, *rows), config, **more).collect()
    return [dict((r.seq, r.cluster_id) for r in found)[i] for i in range(len(rows))]


LINK = lambda **k: {"linkedin": None, "github": None, "portfolio": None, "other": []} | k


def test_each_strong_key_merges(spark):
    rows = [{"emails": ["A@x.co "]}, {"emails": ["a@x.co"], "phones": ["9876543210"]}, {"phones": ["+91 98765 43210"], "links": LINK(linkedin="linkedin.com/in/Me")},
            {"links": LINK(linkedin="https://www.linkedin.com/in/me/", github="github.com/me")}, {"links": LINK(github="https://github.com/ME/repo")}, {"full_name": "Alone"}]
    assert clusters(spark, *rows) == [0, 0, 0, 0, 0, 5]
    assert clusters(spark, *rows, by_pairs=True) == [0, 0, 0, 0, 0, 5]


def test_names_alone_never_merge(spark):
    assert clusters(spark, {"full_name": "Rahul Sharma"}, {"full_name": "Rahul Sharma"}) == [0, 1]


def test_threshold_takes_the_pair_path(spark):
    rows = [{"phones": ["9876543210"], "full_name": "A B"}, {"phones": ["9876543210"], "full_name": "C D"}, {"phones": ["9876543210"], "full_name": "B A"}]
    assert clusters(spark, *rows, config=Config(merge_threshold=110)) == [0, 1, 0]


def test_scores_name_their_signals(spark):
    r = records(spark, {"emails": ["a@x.co", "a@x.co"], "full_name": "Bob Smith", "skills": ["Go", "SQL"]}, {"emails": ["a@x.co"], "full_name": "Robert Smith", "skills": ["go"]})
    feats = resolve.features(r)
    (pair,) = resolve.score_pairs(resolve.block_pairs(resolve.block_keys(feats)), feats).collect()
    assert (pair.seq_a, pair.seq_b, pair.total_score, pair.is_match) == (0, 1, 140.0, True)
    assert [s.signal_type for s in pair.signals] == ["email_match", "name_similarity", "skill_overlap"]
    assert pair.signals[0].details == "Matching emails: a@x.co"


def test_empty(spark):
    assert clusters(spark) == []
    result = resolve_records(records(spark))
    assert result.summary.first().asDict() == {"total_profiles": 0, "clusters_with_merges": 0}
    assert result.output.count() == 0


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(i, (i + 1) % 12) for i in range(12)], [(3, 3), (9, 2), (2, 9), (9, 30)], []])
def test_components(spark, edges):
    parent = list(range(41))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = connected_components(spark.range(41), spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert {r.id: r.component for r in found} == {i: root(i) for i in range(41)}


JOB = lambda c, t, s=None: {"company": c, "title": t, "start_date": s, "end_date": "present", "description": "d"}


@pytest.fixture(scope="module")
def merged(spark):
    r = records(
        spark,
        {"source_type": "pdf", "full_name": "bob smith", "emails": ["B@x.co", " "], "skills": ["k8s", "Foo"], "years_experience": 9.0, "location": {"city": "new-york", "region": None, "country": "USA"}},
        {"source_type": "github", "full_name": "Robert Smith", "emails": ["b@x.co", "c@x.co"], "links": LINK(github="http://github.com/bob/"), "skills": ["Kubernetes"], "headline": " dev "},
        {"source_type": "resume_json", "full_name": "Dr. Robert K Smith", "emails": ["c@x.co"], "phones": ["9876543210"], "skills": ["kube", "Go"], "experience": [JOB("Co", "T", "Jan 2020"), JOB("CO", "t")]},
        {"source_type": "hr_system", "full_name": "Other"},
    )
    c = materialise(resolve.cluster(r))
    p, log = merge.merge(r, c)
    log = materialise(log)
    return r, c, materialise(confidence.score_profiles(p, log)).orderBy("cluster_id"), log


def test_merge(merged):
    one, other = (x.asDict(True) for x in merged[2].collect())
    assert one["full_name"] == "Robert K Smith"
    assert one["emails"] == ["b@x.co", "c@x.co"] and one["phones"] == ["+919876543210"]
    assert one["location"] == {"city": "New-York", "region": None, "country": "US"}
    assert one["links"]["github"] == "https://github.com/bob" and one["headline"] == "dev" and one["years_experience"] == 9.0
    assert one["skills"] == [
        {"name": "Kubernetes", "confidence": 0.95, "sources": ["pdf", "github", "resume_json"]}, {"name": "Go", "confidence": 0.95, "sources": ["resume_json"]},
        {"name": "Foo", "confidence": 0.5, "sources": ["pdf"]},
    ]
    assert one["experience"] == [{"company": "Co", "title": "T", "start": "2020-01", "end": "present", "summary": "d"}]
    assert one["merged_from"] == ["r0", "r1", "r2"]
    seed = "email:b@x.co|email:c@x.co|github:http://github.com/bob/|phone:9876543210"
    assert one["candidate_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, seed))
    assert other["candidate_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "name:other"))


def test_provenance(merged):
    _, _, p, log = merged
    cid = p.first().candidate_id
    rows = provenance.history(log, cid).collect()
    assert [r.field for r in rows] == ["full_name", "emails", "emails", "phones", "location", "links.github", "headline", "years_experience", "skills.Kubernetes", "skills.Foo", "skills.Kubernetes", "skills.Kubernetes", "skills.Go", "experience.Co"]
    assert rows[0].method == "conflict_resolution" and rows[0].value == '"Robert K Smith"' and rows[0].source == "resume_json"
    assert [r.method for r in rows[8:11]] == ["keyword_extraction", "keyword_extraction", "repo_language_analysis"]
    explained = {r.field: r for r in provenance.explain(log.where(F.col("candidate_id") == cid)).collect()}
    assert explained["skills.Kubernetes"].source_count == 3
    assert provenance.rekey(log, cid, "new").where("candidate_id = 'new'").count() == len(rows)
    assert json.loads(provenance.to_json(log).first().json)["metadata"] == {}


def test_confidence(merged):
    _, _, p, log = merged
    one = p.first()
    fields = {r.field: float(r.confidence) for r in confidence.field_confidences(log.where(F.col("candidate_id") == one.candidate_id)).collect()}
    assert fields == {"full_name": 0.95, "emails": 1.0, "phones": 0.9, "location": 0.85, "links": 0.95, "headline": 0.85, "years_experience": 0.8, "skills": 1.0, "experience": 0.85}
    base = 0.95 * 0.15 + 0.15 + 0.09 + 0.05 * (0.85 + 0.95 + 0.85 + 0.8) + 0.15 + 0.85 * 0.15
    assert one.overall_confidence == pytest.approx(min(1, base * 0.9 + 0.15), abs=1e-4)
    b = confidence.breakdown(p, log).where(F.col("candidate_id") == one.candidate_id).first()
    assert b.field_confidences["education"] == 0.0 and b.source_contributions["pdf"] >= 3 and b.coverage == 0.9


def test_resolution(merged):
    r, c, _, _ = merged
    stated = r.join(c, "seq").select("cluster_id", "seq", "source_type", F.col("full_name").alias("value"))
    x = merge.resolution("full_name", stated).orderBy("cluster_id").first()
    assert x.conflict and x.chosen_source == "resume_json" and [y.source for y in x.rejected] == ["github", "pdf"]
    assert x.chosen_reason == "Source 'resume_json' has highest trust rank (0)"


def test_report(merged):
    r, c, p, _ = merged
    feats = resolve.features(r)
    rows = report.candidates(p, c, resolve.score_pairs(resolve.block_pairs(resolve.block_keys(feats)), feats))
    assert report.summary(c).first().asDict() == {"total_profiles": 2, "clusters_with_merges": 1}
    texts = [x.text for x in report.candidate_text(rows).collect()]
    assert all("CANDIDATE EXPLAINABILITY REPORT" in t for t in texts)
    assert any("Matching emails: b@x.co" in t for t in texts)


@pytest.fixture(scope="module")
def profile(spark):
    values = {
        "candidate_id": "c1", "full_name": "Rahul Sharma", "emails": ["rahul@gmail.com", "r@work.com"], "phones": ["+919876543210"], "location": ("Bengaluru", "Karnataka", "IN"),
        "links": ("l", "g", None, []), "headline": "Dev", "years_experience": 5.0, "skills": [("Java", 0.9, ["a"]), ("Python", 0.8, ["a"])], "experience": [], "education": [],
        "overall_confidence": 0.9, "merged_from": ["r1"],
    }
    return spark.createDataFrame([tuple(values.values())], ddl(PROFILE))


def shaped(profile, *fields, **more):
    config = {"fields": [{"path": p, "from": f} for p, f in fields], "on_missing": "null"} | more
    return json.loads(projection.to_json(projection.project(profile, config), config).first().json)


def test_projection_paths(profile):
    out = shaped(profile, ("name", "full_name"), ("contact.email", "emails[0]"), ("contact.phone", "phones[0]"), ("all", "emails[*]"), ("names", "skills[*].name"), ("tenth", "emails[10]"), ("city", "location.city"), ("second", "skills[1].name"), ("x", "does.not.exist"))
    assert out == {"name": "Rahul Sharma", "contact": {"email": "rahul@gmail.com", "phone": "+919876543210"}, "all": ["rahul@gmail.com", "r@work.com"], "names": ["Java", "Python"], "tenth": None, "city": "Bengaluru", "second": "Python", "x": None}


def test_projection_skips_what_is_missing(profile):
    assert shaped(profile, ("x", "nope"), ("name", "full_name"), ("p", "links.portfolio"), on_missing="skip") == {"name": "Rahul Sharma"}


def test_projection_extras(spark, profile):
    assert shaped(profile, ("name", "full_name"), include_confidence=True)["_confidence"] == {"overall": 0.9}
    assert "_confidence" not in shaped(profile, ("name", "full_name"))
    assert projection.project(profile, {}).columns == profile.columns
    log = spark.createDataFrame([("c1", (0, 0, 0), "full_name", '"Rahul Sharma"', "resume_json", "p", "direct_assertion", 0.95)], "candidate_id string, ord struct<step:int,seq:bigint,pos:int>, field string, value string, source string, source_path string, method string, confidence double")
    (row,) = projection.project(profile, {"fields": [{"path": "name", "from": "full_name"}], "include_provenance": True}, log).first()["_provenance"]
    assert (row.value, row.source) == ("Rahul Sharma", "resume_json")


def test_validation():
    assert projection.validate({"fields": [{"path": "a", "from": "b[0].c"}], "on_missing": "null"}) == []
    assert any("on_missing" in x for x in projection.validate({"on_missing": "invalid_value"}))
    assert len(projection.validate({"fields": [{"from": "x"}, {"path": "a", "from": "b["}]})) == 2


def test_config():
    c = Config.from_dict({"entity_resolution": {"weights": {"email_match": 50}, "merge_threshold": 90}, "conflict_resolution": {"trust_hierarchy": ["pdf"]}})
    assert c.weights["email_match"] == 50 and c.weights["phone_match"] == 80 and c.merge_threshold == 90 and c.trust_hierarchy == ["pdf"]
    assert Config.load("/nowhere.json") == Config()


def test_small_numbers(spark):
    row = spark.range(1).select(confidence.match_confidence(F.lit(335), F.lit(375)).alias("m"), confidence.match_confidence(F.lit(1), F.lit(0)).alias("z"), confidence.tier(F.lit(0.6)).alias("t"), confidence.dedup_rate(F.lit(6), F.lit(3)).alias("d"), confidence.source_confidence(F.lit("?")).alias("s")).first()
    assert row.asDict() == {"m": 0.8933, "z": 0.0, "t": "medium", "d": 50.0, "s": 0.4}
