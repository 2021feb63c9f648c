"""Whole runs: command line, streaming, and the registered queries against DuckDB."""

import json
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from rollcall import cli
from rollcall.plans import queries as plans
from rollcall.sinks import write_table
from rollcall.streaming.ingest import number_files, stream_records

DATA = "/root/testdata/sf0.001"
PEOPLE = [
    ("a_resume.json", {"name": "Ann Lee", "email": "ann@x.co", "skills": ["Go"]}),
    ("b_linkedin.json", {"fullName": "Ann Lee", "emailAddress": "ANN@x.co", "headline": "Dev"}),
    ("c_resume.json", {"name": "Bo O'Hara", "phone": "9876543210"}),
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, document in PEOPLE:
        (tmp_path / "in" / name).write_text(json.dumps(document))
    return tmp_path


def test_command_line(spark, folder):
    out = str(folder / "out")
    assert cli.main(["--inputs", str(folder / "in"), "--output", out, "--report", str(folder / "r.json"), "--report-text", str(folder / "r.txt")]) == 0
    assert sorted(os.listdir(out)) == ["ann_lee.json", "ann_lee_report.json", "ann_lee_report.txt", "bo_ohara.json", "bo_ohara_report.json", "bo_ohara_report.txt"]
    assert json.load(open(f"{out}/ann_lee.json"))["emails"] == ["ann@x.co"]
    assert json.load(open(folder / "r.json"))["summary"] == {"total_profiles": 2, "clusters_with_merges": 1}
    assert "Matching emails: ann@x.co" in (folder / "r.txt").read_text()


def test_command_line_fetches_urls_and_names_sources_without_records(spark, folder, monkeypatch, caplog):
    asked = str(folder / "asked")

    def answer(method, url, headers, body, timeout):
        with open(asked, "a") as f:
            f.write(url + "\n")
        return (200, '{"name": "Cy Doe", "login": "cydoe"}' if "/repos" not in url else "[]") if url.startswith("https://api.github.com/users/cydoe") else (404, "")

    monkeypatch.setattr(cli, "http", answer)
    (folder / "in" / "d_resume.json").write_text("{broken")
    (folder / "in" / "notes.txt").write_text("nothing reads this")
    out = str(folder / "out")
    assert cli.main(["--inputs", str(folder / "in"), "https://github.com/cydoe", "https://nobody.example", "--output", out]) == 0
    assert "cy_doe.json" in os.listdir(out)
    assert len(open(asked).readlines()) == 3  # profile, repositories, page
    silent = [r.getMessage().rsplit("/", 1)[-1] for r in caplog.records if r.getMessage().startswith("no records from")]
    assert silent == ["d_resume.json", "notes.txt", "nobody.example"]


def test_command_line_refuses_missing_input():
    assert cli.main(["--inputs", "/no/such/path"]) == 1


def test_streaming(spark, folder):
    query = stream_records(spark, str(folder / "in"), str(folder / "table"), str(folder / "state"))
    query.awaitTermination(120)
    assert {r.full_name for r in spark.read.parquet(str(folder / "table")).collect()} == {"Ann Lee", "Bo O'Hara"}


def test_streaming_numbers_files_by_batch_then_path(spark, folder):
    table, order = str(folder / "table"), []
    for batch in ("z", "y"):
        for i in range(30):
            (folder / "in" / f"{batch}{i:02d}_resume.json").write_text(json.dumps({"name": f"{batch}{i}", "email": f"{batch}{i}@x.co"}))
        stream_records(spark, str(folder / "in"), table, str(folder / "state")).awaitTermination(120)
        order += [p for p in sorted(os.listdir(folder / "in")) if p not in order]
    got = spark.read.parquet(table).orderBy("seq").select("source_path", "seq").collect()
    assert [r.source_path.rsplit("/", 1)[-1] for r in got] == order and len({r.seq for r in got}) == len(order)


def test_streaming_numbers_many_batches_and_files_apart(spark, tmp_path):
    batches = {e: spark.range(1500).selectExpr(f"concat('{e}/', id) path") for e in (0, 16, 2000)}
    seqs = [r.seq for e, b in batches.items() for r in number_files(b, str(tmp_path), e).collect()]
    assert sorted(seqs) == list(range(4500))
    assert sorted(r.seq for r in number_files(batches[16], str(tmp_path), 16).collect()) == list(range(1500, 3000))


def test_write_table(spark, tmp_path):
    write_table(spark.range(4).withColumnRenamed("id", "x"), str(tmp_path / "t"), form="json")
    assert spark.read.json(str(tmp_path / "t")).count() == 4


def rows_of(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", ["name_normalize", "name_similarity", "phone_e164", "date_normalize", "country_normalize", "skill_list_dedup", "url_normalize", "html_strip", "text_emails", "json_projections", "pair_scores", "clusters_by_pairs", "overall_confidence", "project_wildcard"])
def test_query_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("customer", "orders", "documents", "pages", "events", "part"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows_of(plans.QUERIES[name](spark, DATA).toPandas()) == rows_of(db.sql(plans.ORACLE[name]).df())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["cluster_id", "full_name", "years_experience", "github", "n_records"] and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
