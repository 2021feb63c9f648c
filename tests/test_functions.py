"""Scalar functions on literals; each table is one Spark job."""

import pytest
from pyspark.sql import functions as F

from rollcall.functions import countries, dates, education, names, phones, skills, strings, tables, text, urls

CASES = {
    "name": (names.normalize_name, [
        ("rahul sharma", "Rahul Sharma"), ("RAHUL  SHARMA", "Rahul Sharma"), ("Rahul K Sharma", "Rahul K Sharma"), ("dr. priya patel", "Priya Patel"),
        ("k. rahul", "K. Rahul"), ("o'brien j.r.", "Obrien J.r."), ("Md Ali", "Ali"), ("  ", None), ("", None), (None, None), ("!!", None),
    ]),
    "phone": (phones.normalize_phone, [
        ("9876543210", "+919876543210"), ("+91 98765 43210", "+919876543210"), ("91-9876543210", "+919876543210"), ("1-555-123-4567", "+15551234567"),
        ("+4412345678", "+4412345678"), ("12345", None), ("12345678", None), ("invalid", None), ("", None), (None, None),
    ]),
    "phone in the US": (lambda x: phones.normalize_phone(x, "US"), [("(555) 123-4567", "+15551234567")]),
    "date": (dates.normalize_date, [
        ("Jan 2023", "2023-01"), ("January 2023", "2023-01"), ("01/2023", "2023-01"), ("1/2023", "2023-01"), ("01-2023", "2023-01"), ("2023-01", "2023-01"),
        ("2023/1", "2023-01"), ("2023-01-15", "2023-01"), ("01/15/2023", "2023-01"), ("15/01/2023", "2023"), ("2023-13", "2023"), ("2023", "2023"),
        ("Sept-2020", "2020-09"), ("2020 dec", "2020-12"), ("Present", "present"), ("till date", "present"), ("Foo 2023", None), ("1850", None), ("x", None),
        ("", None), (None, None),
    ]),
    "country": (countries.normalize_country, [
        ("India", "IN"), ("IND", "IN"), ("Republic of India", "IN"), ("in", "IN"), ("UK", "GB"), ("USA", "US"), ("United States of America", "US"),
        ("Deutschland", "DE"), ("Kenya", "KE"), ("KEN", "KE"), ("xyznotacountry", None), ("Tanza", "TZ"), ("united", "AE"), ("korea, south", None), ("", None), ("  ", None), (None, None),
    ]),
    "skill": (skills.normalize_skill, [("JAVA", "Java"), ("Core Java", "Java"), ("k8s", "Kubernetes"), ("JDK", "JDK"), (" odd thing ", "odd thing"), ("", None), (None, None)]),
    "known skill": (skills.is_known_skill, [("core java", True), ("JDK", False), (None, False)]),
    "url": (urls.normalize_url, [
        ("https://www.LinkedIn.com/in/Rahul-S/?x=1", "https://linkedin.com/in/Rahul-S"), ("http://github.com/a/", "https://github.com/a"), ("github.com/a", "https://github.com/a"),
        ("https://a.com/p?ref=g#top", "https://a.com/p"), ("https://a.com:8080/x/;y", "https://a.com:8080/x"), ("", None), ("  ", None), (None, None), ("https://", None),
    ]),
    "linkedin": (urls.linkedin_username, [("https://www.linkedin.com/in/rahul/", "rahul"), ("https://linkedin.com/company/x", None), (None, None)]),
    "github": (urls.github_username, [("github.com/Ab/repo", "Ab"), ("https://github.com/login", None), ("https://github.com/Topics/x", None), (None, None)]),
    "class": (urls.classify_url, [("linkedin.com/in/x", "linkedin"), ("github.com/a", "github"), ("https://me.dev/x", "portfolio"), ("x.org", "other"), (None, None)]),
    "title": (strings.title_case, [("new-york", "New-York"), ("HYDERABAD", "Hyderabad"), ("o'brien", "O'Brien"), (None, None)]),
    "bytes": (lambda x: strings.format_bytes(x.cast("long")), [
        ("0", "0 Bytes"), ("1023", "1023 Bytes"), ("1024", "1 KB"), ("1536", "1.5 KB"), ("1048576", "1 MB"), ("1073741824", "1 GB"), ("5497558138880", "5120 GB"), ("-1", None), (None, None),
    ]),
    "phones": (lambda x: F.array_join(phones.normalize_phones(F.split(x, ",")), ","), [("9876543210, 12,+4412345678", "+919876543210,+4412345678"), ("", ""), (None, "")]),
    "html": (text.strip_html, [("<p>a&amp;b</p><script>x</script> <b>c</b>&#39;", "a b c"), ("<style>\np</style>x", "x"), ("", ""), (None, None)]),
    "years": (text.years_of_experience, [("5+ years of experience", 5.0), ("Experience: 7 yrs", 7.0), ("3 yrs in the industry", 3.0), ("none", None), (None, None)]),
    "name in text": (text.name_guess, [("RESUME\nKalluriNikhil a@b.co\nx", "Kalluri Nikhil"), ("one\ntwo three", "Two Three"), ("12 34", None), ("", None), (None, None)]),
    "skills in text": (lambda x: F.array_join(text.skills_in(x, ["Java", "C++", "Go"]), ","), [("java and c++11", "Java,C++"), ("c++ gopher", ""), ("Go", "Go")]),
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    function, cases = CASES[name]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
    assert [(cases[r.i][0], r.y) for r in rows] == cases


def similarity(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(names.name_similarity(F.col("a"), F.col("b")).alias("s")).first().s


def test_name_similarity(spark):
    assert similarity(spark, "Bob Smith", "Robert Smith") == pytest.approx(1.0)
    assert similarity(spark, "Rahul Sharma", "Rahul K Sharma") == pytest.approx(0.8)
    assert similarity(spark, "Rahul Sharma", "Sharma Rahul") == pytest.approx(1.0)
    assert similarity(spark, "Rahul Sharma", "Priya Patel") == 0.0
    assert similarity(spark, None, "x") == 0.0
    assert similarity(spark, "", "") == 0.0


def test_skill_list_keeps_the_first_of_each(spark):
    row = spark.sql("SELECT array('java', 'Core Java', 'Foo', 'foo', ' ', null, 'k8s') AS x").select(skills.normalize_skills(F.col("x")).alias("y")).first()
    assert row.y == ["Java", "Foo", "Kubernetes"]


def test_links_and_contacts(spark):
    t = "me@x.com me@x.com +91 9876543210 https://www.linkedin.com/in/nik https://github.com/nik https://nik.dev/ https://blog.x.org leetcode.com/nik"
    row = spark.createDataFrame([(t,)], "t string").select(text.emails(F.col("t")).alias("e"), text.phones(F.col("t")).alias("p"), text.links(F.col("t")).alias("l")).first()
    assert row.e == ["me@x.com"] and row.p == ["+91 9876543210"]
    assert row.l.asDict() == {"linkedin": "https://www.linkedin.com/in/nik", "github": "https://github.com/nik", "portfolio": "https://nik.dev", "other": ["https://blog.x.org", "https://leetcode.com/nik"]}


def test_education(spark):
    t = "Me\nEducation\nABC College of Engineering\nB.Tech in Computer Science 2018 - 2022 CGPA: 9.1/10\nXYZ School\nSSC 2016 98%\nSkills\nJava"
    found = spark.createDataFrame([(t,), ("none",), (None,)], "t string").select(education.education(F.col("t")).alias("e")).collect()
    first, second = found[0].e
    assert (first.institution, first.degree, first.field_of_study, first.start_date, first.end_date) == ("ABC College of Engineering", "B.Tech", "Computer Science", "2018", "2022")
    assert (second.institution, second.degree, second.end_date) == ("XYZ School", "SSC", "2016")
    assert found[1].e == [] and found[2].e == []


class Library:
    """As much of the phonenumbers package as is used."""

    class NumberParseException(Exception):
        pass

    class PhoneNumberFormat:
        E164 = 0

    def parse(self, phone, region):
        if not any(c.isdigit() for c in phone):
            raise self.NumberParseException
        return ("" if region is None else "+91") + phone.replace(" ", "")

    def is_possible_number(self, number):
        return len(number) > 8

    def format_number(self, number, form):
        return number


def test_phones_by_the_library():
    assert [phones.parsed_e164(Library(), x, "IN") for x in ("+44 1234567", "98765 43210", "+12", "none")] == ["+441234567", "+919876543210", None, None]


def test_phone_lists_by_the_library(spark, monkeypatch):
    monkeypatch.setattr(phones, "has_library", lambda: True)
    plan = spark.createDataFrame([(["9876543210"],)], "x array<string>").select(phones.normalize_phones(F.col("x")))._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan


def test_taxonomy_of_the_working_folder(tmp_path, monkeypatch):
    assert tables.read_taxonomy(None) is None
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "skill_taxonomy.json").write_text('{"skills": [{"canonical": "Zig", "aliases": ["ziglang"]}]}')
    monkeypatch.chdir(tmp_path)
    assert tables.read_taxonomy(None) == {"Zig": ["ziglang"]}
    (tmp_path / "config" / "skill_taxonomy.json").write_text("broken")
    assert tables.read_taxonomy(None) == {}
