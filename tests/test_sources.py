"""Readers on small files of every kind."""

import json

import pytest
from pyspark.sql import functions as F

from rollcall.functions.text import strip_html
from rollcall.sources import csv_records
from rollcall.sources.discover import discover, source_type
from rollcall.sources.ingest import ingest, rejected
from rollcall.sources.json_records import PROJECTIONS
from rollcall.sources.text_records import from_portfolio_text


def project(spark, kind, document):
    members, shape = PROJECTIONS[kind]
    rows = spark.createDataFrame([(json.dumps(document),)], "d string").select(F.explode(members(F.parse_json("d"))).alias("m")).select(shape(F.col("m")).alias("r")).select("r.*").collect()
    return [r.asDict(True) for r in rows]


def test_dispatch(spark):
    kinds = {
        "https://linkedin.com/in/x": "linkedin_json", "a/linkedin_x.json": "linkedin_json", "https://github.com/x": "github", "a/github.json": "github",
        "a/resume_chris.json": "hr_system", "a/cv.json": "resume_json", "a/x.csv": "ats_csv", "a/cats.json": "ats_json", "a/x.pdf": "pdf",
        "https://me.dev": "portfolio_web", "https://linkedin.com/company/x": None, "a/x.txt": None,
    }
    rows = spark.createDataFrame([(p,) for p in kinds], "p string").select("p", source_type(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in rows} == kinds


def test_null_stops_present_keys(spark):
    (r,) = project(spark, "linkedin_json", {"firstName": None, "first_name": "A", "lastName": "B", "location": "X, Y, Z", "skills": [{"name": "Go"}, "C"], "positions": [{"companyName": "Co", "startDate": {"year": 2020, "month": 3}, "endDate": {"year": 2021}}]})
    assert r["full_name"] == "B"
    assert r["location"] == {"city": "X", "region": "Y", "country": "Z"}
    assert r["skills"] == ["Go", "C"]
    assert (r["experience"][0]["start_date"], r["experience"][0]["end_date"]) == ("2020-03", "2021")


def test_resume_passes_over_null(spark):
    (r,) = project(spark, "resume_json", {"full_name": None, "name": "A B", "emails": "a@b.co", "years_of_experience": "4.5", "location": "somewhere", "city": "X", "education": [{"school": "S", "end_date": 2020}]})
    assert (r["full_name"], r["emails"], r["years_experience"], r["location"]["city"]) == ("A B", ["a@b.co"], 4.5, "X")
    assert r["education"][0]["institution"] == "S" and r["education"][0]["end_date"] is None


def test_ats_and_hr_lists(spark):
    found = project(spark, "ats_json", {"candidates": [{"full_name": "A", "experience": [{"company": "C", "current": True}], "education": [{"graduationYear": 2020}]}, 7, {"first_name": "B", "last_name": "C", "socialProfiles": {"github": "g"}}]})
    assert [r["full_name"] for r in found] == ["A", "B C"]
    assert found[0]["experience"][0]["end_date"] == "present" and found[0]["education"][0]["end_date"] == "2020" and found[1]["links"]["github"] == "g"
    (r,) = project(spark, "hr_system", [{"employee_name": "E", "work_email": "e@x.co", "competencies": "a, b,,", "tenure_years": 3}])
    assert (r["full_name"], r["emails"], r["skills"], r["years_experience"]) == ("E", ["e@x.co"], ["a", "b"], 3.0)


def test_github(spark):
    (r,) = project(spark, "github", {"profile": {"login": "u", "name": "N", "email": None, "location": "X, Y", "blog": ""}, "repos": [{"language": "Go", "topics": ["b", "a"]}, {"language": "Go"}, {"language": None}]})
    assert r["skills"] == ["Go", "a", "b"] and r["github_username"] == "u" and r["emails"] == []
    assert r["location"] == {"city": "X", "region": None, "country": "Y"} and r["links"]["portfolio"] is None


def test_ingest_isolates_bad_files(spark, tmp_path):
    (tmp_path / "a_resume.json").write_text("{invalid json content!!!}")
    (tmp_path / "b_resume.json").write_text(json.dumps({"name": "A B", "email": "a@b.co"}))
    (tmp_path / ".hidden_resume.json").write_text(json.dumps({"name": "No"}))
    (tmp_path / "c.csv").write_bytes("﻿Candidate Name,E-Mail,Skills,YOE\nC D,c@d.co;x,\"a;b|c\",5\n,,x,1\n".encode())
    rows = ingest(spark, [str(tmp_path), str(tmp_path / "missing")]).orderBy("seq").collect()
    assert [r.full_name for r in rows] == ["A B", "C D"]
    assert rows[1].skills == ["a", "b", "c"] and rows[1].years_experience == 5.0
    documents = spark.createDataFrame([("p", "{x")], "path string, document string")
    assert rejected(documents).first().reason == "malformed JSON"


def test_no_sources(spark, tmp_path):
    assert ingest(spark, [str(tmp_path)]).count() == 0
    assert discover(spark, [str(tmp_path)]).count() == 0


def test_remote_sources(spark):
    def transport(method, url, headers, body, timeout):
        import json

        if url.endswith("/users/u"):
            return 200, json.dumps({"name": "Hub User", "html_url": "https://github.com/u"})
        if "/repos" in url:
            return 403, ""
        if "me.dev" in url:
            return 200, "<p>me@me.dev github.com/u</p>"
        raise OSError("no network")

    rows = ingest(spark, ["https://github.com/u", "https://me.dev/x", "https://down.org"], transport=transport).orderBy("seq").collect()
    assert [(r.source_type, r.full_name, r.links.github) for r in rows] == [("github", "Hub User", "https://github.com/u"), ("portfolio_web", None, "https://github.com/u")]


def test_portfolio(spark):
    r = spark.createDataFrame([("<b>a@b.co</b> linkedin.com/in/me",)], "h string").select(from_portfolio_text(strip_html(F.col("h")), F.lit("https://x.org"), []).alias("r")).first().r
    assert r.emails == ["a@b.co"] and r.links.linkedin == "https://linkedin.com/in/me" and r.links.portfolio == "https://x.org"


@pytest.mark.parametrize("kind", PROJECTIONS)
def test_empty_documents(spark, kind):
    for r in project(spark, kind, {}):
        assert r["emails"] == [] and r["skills"] == [] and r["full_name"] is None


def test_csv_that_is_not_utf8_is_read_as_latin1(spark, tmp_path):
    text = "Name,City\nJosé Núñez,Málaga\nAnn Lee,Köln\n"
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):
        (tmp_path / f"{encoding}.csv").write_bytes(text.encode(encoding))
        rows = csv_records.read_rows(spark, str(tmp_path / f"{encoding}.csv")).orderBy("_place").collect()
        assert [tuple(r)[:2] for r in rows] == [("José Núñez", "Málaga"), ("Ann Lee", "Köln")], encoding
