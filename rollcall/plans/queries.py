"""Registered queries: each runs an operator over whole tables, most with the same query in DuckDB's SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FIELD_WEIGHTS, SKILL_METHODS, Config
from ..functions import countries, dates, names, phones, skills, strings, text, urls
from ..functions.tables import country_aliases, months, nicknames, skill_aliases
from ..operators import confidence, merge, projection, provenance, report, resolve
from ..schema import RAW_EDUCATION, RAW_EXPERIENCE, RECORD, conform
from ..shared import materialise, shared_dir, tasks
from ..sinks import file_stem
from ..sources import csv_records, json_records, text_records, variants

# The person relation that is derived from the customer table; the same text runs in Spark and DuckDB.
PEOPLE = """
SELECT seq, person, source_type,
  CASE CAST(seq % 5 AS INT) WHEN 0 THEN upper(base_name) WHEN 1 THEN lower(base_name)
       WHEN 2 THEN concat('Dr. ', base_name) WHEN 3 THEN concat(given, ' K ', family) ELSE base_name END AS full_name,
  CASE WHEN seq % 3 = 0 OR seq % 13 = 5 THEN NULL WHEN seq % 7 = 0 THEN concat('USER', CAST(person AS STRING), '@EXAMPLE.COM')
       ELSE concat('user', CAST(person AS STRING), '@example.com') END AS email,
  CASE WHEN seq % 3 = 1 OR seq % 13 = 5 THEN NULL WHEN seq % 2 = 0 THEN concat('+91 ', digits) ELSE digits END AS phone,
  CASE WHEN seq % 4 = 0 THEN concat('https://www.GitHub.com/user-', CAST(person AS STRING), '/') END AS github,
  CASE CAST(person % 4 AS INT) WHEN 0 THEN 'Mumbai' WHEN 1 THEN 'new-york' WHEN 2 THEN 'HYDERABAD' ELSE NULL END AS city,
  CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'India' WHEN 1 THEN 'USA' WHEN 2 THEN 'UK' WHEN 3 THEN 'ind' WHEN 4 THEN 'xyznotacountry' ELSE NULL END AS country,
  CASE CAST(seq % 7 AS INT) WHEN 0 THEN 'Core Java' WHEN 1 THEN 'JDK' WHEN 2 THEN 'k8s' WHEN 3 THEN 'AWS Cloud' WHEN 4 THEN 'python3' WHEN 5 THEN 'PostgreSQL' ELSE 'UnknownSkill' END AS skill,
  CAST(seq % 11 AS INT) AS yoe
FROM (SELECT seq, person, given, family, concat(given, ' ', family) AS base_name,
        concat('98', lpad(CAST((person * 7919) % 100000000 AS STRING), 8, '0')) AS digits,
        CASE CAST(seq % 8 AS INT) WHEN 0 THEN 'resume_json' WHEN 1 THEN 'linkedin_json' WHEN 2 THEN 'github' WHEN 3 THEN 'ats_csv'
          WHEN 4 THEN 'ats_json' WHEN 5 THEN 'hr_system' WHEN 6 THEN 'portfolio_web' ELSE 'pdf' END AS source_type
      FROM (SELECT c_custkey AS seq, CAST(floor(c_custkey / 3) AS BIGINT) AS person,
              CASE CAST(floor(c_custkey / 3) % 7 AS INT) WHEN 0 THEN 'Rahul' WHEN 1 THEN 'Bob' WHEN 2 THEN 'Mohammed' WHEN 3 THEN 'Priya' WHEN 4 THEN 'Kate' WHEN 5 THEN 'Sergey' ELSE 'Amit' END AS given,
              CASE CAST(floor(c_custkey / 3) % 5 AS INT) WHEN 0 THEN 'Sharma' WHEN 1 THEN 'Smith' WHEN 2 THEN 'Ali' WHEN 3 THEN 'Patel' ELSE 'O''Brien' END AS family
            FROM customer) a) b
"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person relation, dealt to tasks by its rows: a file of a few bytes a row would be one task's work."""
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return spark.sql(PEOPLE.replace("FROM customer", "FROM {customer}"), customer=customer.repartition(tasks(customer), "c_custkey"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person relation as raw records; each also holds one job."""
    p = people(spark, sf_dir)
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    job = F.struct(F.concat(F.lit("Company "), (F.col("person") % 4 + F.col("seq") % 2).cast("string")).alias("company"), F.lit("Engineer").alias("title"), F.lit("01/2020").alias("start_date"), F.lit("present").alias("end_date"), F.lit(None).cast("string").alias("description"))
    none = F.lit(None).cast("string")
    return conform(
        p.select(
            F.concat(F.lit("r"), F.col("seq").cast("string")).alias("record_id"), "seq", "source_type", F.concat(F.lit("people/"), F.col("seq").cast("string")).alias("source_path"), "full_name",
            one(F.col("email")).alias("emails"), one(F.col("phone")).alias("phones"), F.struct(F.col("city"), none.alias("region"), F.col("country")).alias("location"),
            F.struct(none.alias("linkedin"), F.col("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other")).alias("links"),
            F.col("yoe").alias("years_experience"), F.array("skill").alias("skills"), F.array(job).cast(RAW_EXPERIENCE).alias("experience"), F.array().cast(RAW_EDUCATION).alias("education"),
        ),
        RECORD,
    )


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(pairs: dict[str, str]) -> str:
    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs.items())


def case_of(pairs: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in pairs.items()) + " END"


def over(x: str, by: str = "WHERE true") -> str:
    return f"WITH people AS ({PEOPLE}) {x}"


# --- scalar functions

NAME_SQL = r"""array_to_string(list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\b(mr|mrs|ms|dr|prof|sir|md|phd)\b\.?', '', 'g'), '[^\w\s.]', '', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ')"""
PHONE_SQL = """CASE WHEN {0} IS NULL THEN NULL WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) < 7 THEN NULL
  WHEN trim({0}) LIKE '+%' THEN '+' || regexp_replace({0}, '[^0-9]', '', 'g') WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) = 10 THEN '+91' || regexp_replace({0}, '[^0-9]', '', 'g')
  WHEN length(regexp_replace({0}, '[^0-9]', '', 'g')) >= 10 THEN '+' || regexp_replace({0}, '[^0-9]', '', 'g') END"""
URL_SQL = r"""CASE WHEN regexp_extract(regexp_replace(trim({0}), '^(?i:https?://)', ''), '^([^/?#]*)', 1) = '' THEN NULL ELSE
  'https://' || regexp_replace(lower(regexp_extract(regexp_replace(trim({0}), '^(?i:https?://)', ''), '^([^/?#]*)', 1)), '^www\.', '')
  || regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim({0}), '^(?i:https?://)', ''), '^[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') END"""
SKILL_SQL = f"coalesce({case_of(skill_aliases(), 'lower(trim({0}))')}, trim({{0}}))"
COUNTRY_SQL = case_of(country_aliases(), "lower(trim({0}))")


@query(over(f"SELECT seq, {NAME_SQL.format('full_name')} AS name FROM people"))
def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("seq", names.normalize_name(F.col("full_name")).alias("name"))


@query(over(r"SELECT seq, array_to_string(list_transform(string_split_regex(trim(full_name), '\s+'), lambda t: lower(regexp_replace(t, '\.+$', ''))), ' ') AS tokens FROM people"))
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("seq", F.array_join(names.name_tokens(F.col("full_name")), " ").alias("tokens"))


_NICK = "MAP {" + ", ".join(f"{quoted(k)}: [{', '.join(map(quoted, v))}]" for k, v in nicknames().items()) + "}"
SIMILARITY_SQL = rf"""
  nick AS (SELECT {_NICK} AS m),
  tok AS (SELECT seq, person, list_transform(string_split_regex(trim(full_name), '\s+'), lambda t: lower(regexp_replace(t, '\.+$', ''))) AS t FROM people),
  wide AS (SELECT seq, person, t, list_distinct(flatten(list_transform(t, lambda x: coalesce(map_extract(m, x)[1], [x])))) AS w FROM tok, nick),
  pairs AS (SELECT a.seq AS seq_a, b.seq AS seq_b, a.t AS ta, b.t AS tb, a.w AS wa, b.w AS wb FROM wide a JOIN wide b ON a.person = b.person AND a.seq < b.seq),
  sides AS (SELECT *, CASE WHEN len(ta) <= len(tb) THEN ta ELSE tb END AS short, CASE WHEN len(ta) <= len(tb) THEN wb ELSE wa END AS long FROM pairs, nick)
"""


@query(
    over(
        f"SELECT * FROM (WITH {SIMILARITY_SQL} SELECT seq_a, seq_b, round(0.6 * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) "
        "+ 0.4 * len(list_filter(short, lambda t: list_has_any(coalesce(map_extract(m, t)[1], [t]), long))) / len(short), 6) AS similarity FROM sides)"
    )
)
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir).select("seq", "person", "full_name")
    other = p.toDF("seq_b", "person", "other_name")
    pairs = p.withColumnRenamed("seq", "seq_a").join(other, "person").where("seq_a < seq_b")
    return pairs.select("seq_a", "seq_b", F.round(names.name_similarity(F.col("full_name"), F.col("other_name")), 6).alias("similarity"))


@query(over(f"SELECT seq, {PHONE_SQL.format('phone')} AS e164 FROM people"))
def phone_e164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("seq", phones.normalize_phone(F.col("phone")).alias("e164"))


# the order date written in eleven ways
_DATED = """SELECT o_orderkey, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN concat(mon, ' ', y) WHEN 1 THEN concat(y, '-', m) WHEN 2 THEN concat(m, '/', y) WHEN 3 THEN concat(m, '-', y)
  WHEN 4 THEN concat(y, '/', m) WHEN 5 THEN concat(y, '-', m, '-', d) WHEN 6 THEN concat(m, '/', d, '/', y) WHEN 7 THEN concat(d, '/', m, '/', y) WHEN 8 THEN y WHEN 9 THEN concat(mon, '-', y) ELSE concat(y, ' ', mon) END AS written,
  y, m, d FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d,
  CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'february' WHEN 3 THEN 'MAR' WHEN 4 THEN 'April' WHEN 5 THEN 'may' WHEN 6 THEN 'Jun' WHEN 7 THEN 'July' WHEN 8 THEN 'aug' WHEN 9 THEN 'Sept' WHEN 10 THEN 'Oct' WHEN 11 THEN 'nov' ELSE 'December' END AS mon FROM orders) x"""


@query(f"SELECT o_orderkey, written, CASE CAST(o_orderkey % 11 AS INT) WHEN 8 THEN y WHEN 7 THEN CASE WHEN CAST(d AS INT) <= 12 THEN y || '-' || d ELSE y END ELSE y || '-' || m END AS date FROM ({_DATED})")
def date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = spark.sql(_DATED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return written.select("o_orderkey", "written", dates.normalize_date(F.col("written")).alias("date"))


@query("SELECT m AS word, month FROM (VALUES " + values({k.upper(): v for k, v in months().items()} | {"3": "03", "12": "12"}) + ") t(m, month) UNION ALL SELECT '13', NULL UNION ALL SELECT 'foo', NULL")
def month_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [(w.upper(),) for w in months()] + [("3",), ("12",), ("13",), ("foo",)]
    return spark.createDataFrame(words, "word string").select("word", dates.resolve_month(F.col("word")).alias("month"))


@query(over(f"SELECT seq, {COUNTRY_SQL.format('country')} AS iso FROM people"))
def country_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("seq", countries.normalize_country(F.col("country"), spark=spark).alias("iso"))


@query(r"""WITH b AS (SELECT doc_id, CAST(n_chars AS BIGINT) * n_chars * (doc_id % 7) AS n FROM documents),
  u AS (SELECT doc_id, n, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM b)
  SELECT doc_id, CASE WHEN n = 0 THEN '0 Bytes' WHEN n > 0 THEN regexp_replace(CAST(CAST(round(n / pow(1024, i), 1) AS DECIMAL(20, 1)) AS VARCHAR), '\.0$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][i + 1] END AS size FROM u""")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strings.format_bytes(F.col("n_chars").cast("long") * F.col("n_chars") * (F.col("doc_id") % 7)).alias("size"))


@query(over(f"SELECT seq, {SKILL_SQL.format('skill')} AS skill, lower(skill) IN ({', '.join(map(quoted, skill_aliases()))}) AS known FROM people"))
def skill_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("skill")
    return people(spark, sf_dir).select("seq", skills.normalize_skill(s).alias("skill"), skills.is_known_skill(s).alias("known"))


@query(
    over(
        f"SELECT seq, string_agg(s, ',' ORDER BY i) AS skills FROM (SELECT seq, s, i, row_number() OVER (PARTITION BY seq, lower(s) ORDER BY i) AS n FROM (SELECT seq, i, {SKILL_SQL.format('x')} AS s FROM (SELECT seq, unnest([skill, upper(skill), 'Python', ' k8s ']) AS x, unnest([1, 2, 3, 4]) AS i FROM people))) WHERE n = 1 GROUP BY seq"
    )
)
def skill_list_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = F.array("skill", F.upper("skill"), F.lit("Python"), F.lit(" k8s "))
    return people(spark, sf_dir).select("seq", F.array_join(skills.normalize_skills(every), ",").alias("skills"))


@query("SELECT skill FROM (VALUES " + ", ".join(f"({quoted(s)})" for s in sorted(set(skill_aliases().values()))) + ") t(skill)")
def canonical_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.canonical_skills(spark)


@query(
    f"SELECT page_id, u AS url, CASE WHEN u IS NULL THEN NULL WHEN lower(u) LIKE '%linkedin.com/in/%' THEN 'linkedin' WHEN lower(u) LIKE '%github.com/%' THEN 'github' "
    f"WHEN regexp_matches(lower(u), 'portfolio|personal|blog|dev\\.|\\.dev') THEN 'portfolio' ELSE 'other' END AS class FROM (SELECT page_id, {URL_SQL.format('url')} AS u FROM pages)"
)
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_url(u).alias("url"), urls.classify_url(u).alias("class"))


@query(over("SELECT seq, 'user-' || person AS github FROM people WHERE github IS NOT NULL"))
def url_username(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).where("github is not null").select("seq", urls.github_username(F.col("github")).alias("github"))


STRIP_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;', ' ', 'g'), '&#\d+;', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, CAST(length(t) AS INT) AS n, md5(t) AS digest FROM (SELECT page_id, {STRIP_SQL} AS t FROM pages)")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    visible = text.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(visible).alias("n"), F.md5(visible.cast("binary")).alias("digest"))


def found_sql(pattern: str) -> str:
    return f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, {quoted(pattern)}))), ',') AS found FROM documents"


def found(spark: SparkSession, sf_dir: str, what: Callable[[Column], Column]) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(what(F.col("text"))), ",").alias("found"))


@query(found_sql(text.EMAIL))
def text_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, text.emails)


@query(found_sql(text.PHONE))
def text_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir, text.phones)


_WORDS = ["Go", "SQL", "The", "And", "C"]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(?:^|[^\\pL\\pN_]){w.lower()}(?:$|[^\\pL\\pN_])') THEN '{w}' END" for w in _WORDS) + "], lambda x: x IS NOT NULL), ',') AS found FROM documents")
def text_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.skills_in(F.col("text"), _WORDS), ",").alias("found"))


@query(over("SELECT seq, CAST(yoe AS DOUBLE) AS years FROM people"))
def text_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = people(spark, sf_dir)
    written = F.when(F.col("seq") % 2 == 0, F.format_string("Over %d+ years of experience in Go", "yoe")).otherwise(F.format_string("Experience: %d yrs", "yoe"))
    return p.select("seq", text.years_of_experience(written).alias("years"))


@query()
def text_education(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education entries of whole texts of documents, with a section put behind each."""
    from ..functions.education import education

    resume = F.concat(F.coalesce("text", F.lit("")), F.lit("\nEducation\nState University\nB.Tech in Physics 2015 - 2019\nCity School\nSSC 2013"))
    e = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(education(resume)).alias("place", "e"))
    return e.select("doc_id", "place", "e.*")


@query(f"SELECT page_id, url AS portfolio, array_to_string(list_sort(list_distinct(regexp_extract_all(t, {quoted(text.EMAIL)}))), ',') AS emails FROM (SELECT page_id, url, {STRIP_SQL} AS t FROM pages)")
def portfolio_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = text_records.from_portfolio_text(text.strip_html(F.col("html")), F.col("url"), [])
    return table(spark, sf_dir, "pages").select("page_id", r.alias("r")).select("page_id", F.col("r.links.portfolio").alias("portfolio"), F.array_join(F.array_sort("r.emails"), ",").alias("emails"))


# --- JSON sources


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", variants.text(variants.at(v, "k")).alias("k"), variants.is_object(v).alias("is_object"))


_TYPES = ["linkedin_json", "resume_json", "ats_json", "hr_system", "github"]


@query(over("SELECT seq, kind, full_name, CASE WHEN kind = 'github' THEN NULL ELSE phone END AS phone, email, CASE WHEN kind = 'github' AND city IS NULL THEN NULL ELSE city END AS city FROM people, (SELECT unnest(['linkedin_json', 'resume_json', 'ats_json', 'hr_system', 'github']) AS kind)"))
def json_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every JSON source's projection of documents made of the person relation, in that source's own words."""
    p = people(spark, sf_dir)
    c = F.col
    documents = {
        "linkedin_json": F.struct(c("full_name").alias("fullName"), c("email").alias("emailAddress"), c("phone"), c("city")),
        "resume_json": F.struct(c("full_name").alias("candidateName"), F.array("email").alias("emailAddresses"), c("phone").alias("mobile"), F.struct("city").alias("address")),
        "ats_json": F.struct(c("full_name"), c("email").alias("emailAddress"), c("phone").alias("phoneNumber"), F.struct("city").alias("location")),
        "hr_system": F.struct(c("full_name").alias("employee_name"), c("email").alias("work_email"), c("phone").alias("work_phone"), c("city").alias("office_city")),
        "github": F.struct(F.struct(c("full_name").alias("name"), c("email"), c("city").alias("location")).alias("profile"), F.array().cast("array<string>").alias("repos")),
    }
    out = None
    for kind in _TYPES:
        v = p.select("seq", F.parse_json(F.to_json(documents[kind])).alias("v"))
        r = v.select("seq", F.lit(kind).alias("kind"), json_records.PROJECTIONS[kind][1](F.col("v")).alias("r"))
        part = r.select("seq", "kind", "r.full_name", F.get("r.phones", F.lit(0)).alias("phone"), F.get("r.emails", F.lit(0)).alias("email"), "r.location.city")
        out = part if out is None else out.union(part)
    return out


# --- CSV and resume text


@query(
    over(
        "SELECT CAST(seq AS VARCHAR) AS headline, full_name, email, phone, skill || ',Python,' || skill AS skills, 'Company ' || person AS company, city, country, github, CAST(yoe AS DOUBLE) AS years_experience, 'School ' || (person % 4) AS institution "
        "FROM (SELECT * REPLACE (CASE WHEN seq % 13 <> 5 THEN full_name END AS full_name) FROM people) WHERE full_name IS NOT NULL OR email IS NOT NULL OR phone IS NOT NULL"
    )
)
def ats_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the person relation as a CSV export under other headers; rows without name, email and phone are of no use."""
    p = people(spark, sf_dir)
    text_of = lambda c: F.col(c).cast("string")
    export = p.select(
        F.when(F.col("seq") % 13 != 5, F.col("full_name")).alias("Candidate Name"), F.col("email").alias("E-Mail"), F.col("phone").alias("Mobile"), F.concat("skill", F.lit("; Python |"), "skill").alias("Technical Skills"),
        F.concat(F.lit("Company "), text_of("person")).alias("Employer"), text_of("seq").alias("Job Title"), F.col("city").alias("City"), F.col("country").alias("Country Code"),
        F.col("github").alias("GitHub Profile"), text_of("yoe").alias("YOE"), F.concat(F.lit("School "), (F.col("person") % 4).cast("string")).alias("University"),
    )
    path = shared_dir(spark)
    export.write.csv(path, header=True)
    rows = csv_records.read_rows(spark, path)
    r = rows.select(csv_records.project([c for c in rows.columns if c != "_place"]).alias("r")).where(csv_records.is_useful(F.col("r")))
    return r.select(
        "r.headline", "r.full_name", F.get("r.emails", F.lit(0)).alias("email"), F.get("r.phones", F.lit(0)).alias("phone"), F.array_join("r.skills", ",").alias("skills"), F.get("r.experience", F.lit(0))["company"].alias("company"),
        "r.location.city", "r.location.country", "r.links.github", "r.years_experience", F.get("r.education", F.lit(0))["institution"].alias("institution"),
    )


RESUME = r"concat('Curriculum Vitae', chr(10), {name}, chr(10), 'Contact: ', coalesce(email, 'none'), chr(10), coalesce(github, 'no page'), chr(10), 'leetcode.com/u', CAST(person AS STRING), '/ https://me.example.org/p', CAST(person AS STRING), '/', chr(10), CAST(person % 30 AS STRING), '+ years of experience in retail')"


@query(
    over(
        "SELECT seq, 'Anna ' || CASE CAST(person % 3 AS INT) WHEN 0 THEN 'Lee' WHEN 1 THEN 'Kim' ELSE 'Maria Roy' END AS name, email, github, 'https://me.example.org/p' || person AS portfolio, 'https://leetcode.com/u' || person AS other, CAST(person % 30 AS DOUBLE) AS years FROM people"
    )
)
def resume_text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a resume's text for each of the person relation: headings, a name, addresses, years."""
    name = "concat('ANNA ', CASE CAST(person % 3 AS INT) WHEN 0 THEN 'lee' WHEN 1 THEN 'Kim' ELSE 'maria roy' END)"
    r = people(spark, sf_dir).select("seq", text_records.from_resume_text(F.expr(RESUME.format(name=name)), []).alias("r"))
    return r.select("seq", F.col("r.full_name").alias("name"), F.get("r.emails", F.lit(0)).alias("email"), "r.links.github", "r.links.portfolio", F.array_join("r.links.other", ",").alias("other"), F.col("r.years_experience").alias("years"))


# --- resolution

KEYS_SQL = f"""
  keys AS (SELECT DISTINCT key_type, key, seq FROM (
    SELECT 'email' AS key_type, lower(trim(email)) AS key, seq FROM people WHERE email IS NOT NULL UNION ALL
    SELECT 'phone', {PHONE_SQL.format("phone")}, seq FROM people WHERE phone IS NOT NULL UNION ALL
    SELECT 'github', 'user-' || person, seq FROM people WHERE github IS NOT NULL))"""
PAIRS_SQL = "pairs AS (SELECT DISTINCT a.seq AS seq_a, b.seq AS seq_b FROM keys a JOIN keys b ON a.key_type = b.key_type AND a.key = b.key AND a.seq < b.seq)"
SCORE_SQL = f"""
  {SIMILARITY_SQL},
  likeness AS (SELECT seq_a, seq_b, 0.6 * len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb)))
     + 0.4 * len(list_filter(short, lambda t: list_has_any(coalesce(map_extract(m, t)[1], [t]), long))) / len(short) AS similarity FROM sides),
  cand AS (SELECT DISTINCT a.seq AS seq_a, b.seq AS seq_b FROM keys a JOIN keys b ON a.key_type = b.key_type AND a.key = b.key AND a.seq < b.seq),
  flags AS (SELECT c.seq_a, c.seq_b,
     coalesce(lower(a.email) = lower(b.email), false) AS email, coalesce(a.phone IS NOT NULL AND b.phone IS NOT NULL AND a.person = b.person, false) AS phone,
     coalesce(lower(a.github) = lower(b.github), false) AS github, coalesce(l.similarity >= 0.85, false) AS name,
     coalesce(lower(a.city) = lower(b.city), false) AS city, (a.person % 4 + a.seq % 2) = (b.person % 4 + b.seq % 2) AS company, lower(a.skill) = lower(b.skill) AS skill
   FROM cand c JOIN people a ON a.seq = c.seq_a JOIN people b ON b.seq = c.seq_b LEFT JOIN likeness l ON l.seq_a = c.seq_a AND l.seq_b = c.seq_b),
  scores AS (SELECT seq_a, seq_b, CAST(100 * CAST(email AS INT) + 80 * CAST(phone AS INT) + 100 * CAST(github AS INT) + 30 * CAST(name AS INT) + 10 * CAST(city AS INT) + 20 * CAST(company AS INT) + 10 * CAST(skill AS INT) AS DOUBLE) AS total_score,
     email::INT + phone::INT + github::INT + name::INT + city::INT + company::INT + skill::INT AS n_signals, email OR phone OR github AS strong FROM flags)"""


def whole(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE people AS ({PEOPLE}), {ctes} {select}"


def clusters_sql(edges: str) -> str:
    return f"""edges AS ({edges}), links AS (SELECT seq_a AS x, seq_b AS y FROM edges UNION SELECT seq_b, seq_a FROM edges),
  reach AS (SELECT seq AS x, seq AS y FROM people UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
  clusters AS (SELECT x AS seq, min(y) AS cluster_id FROM reach GROUP BY x)"""


CLUSTERS_SQL = f"{KEYS_SQL}, {PAIRS_SQL}, {clusters_sql('SELECT seq_a, seq_b FROM pairs')}"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_keys(resolve.features(records(spark, sf_dir)))


@query(whole(KEYS_SQL, "SELECT key_type, key, seq FROM keys"))
def block_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keys(spark, sf_dir)


@query(whole(f"{KEYS_SQL}, {PAIRS_SQL}", "SELECT seq_a, seq_b FROM pairs"))
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.block_pairs(_keys(spark, sf_dir))


def _scores(r: DataFrame, config: Config | None = None) -> DataFrame:
    feats = materialise(resolve.features(r))
    return resolve.score_pairs(resolve.block_pairs(resolve.block_keys(feats)), feats, config)


@query(whole(f"{KEYS_SQL}, {SCORE_SQL}", "SELECT seq_a, seq_b, total_score, CAST(n_signals AS INT) AS n_signals FROM scores"))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(records(spark, sf_dir)).select("seq_a", "seq_b", "total_score", F.size("signals").alias("n_signals"))


@query(whole(f"{KEYS_SQL}, {SCORE_SQL}", "SELECT seq_a, seq_b, total_score >= 130 AND strong AS is_match, least(round(total_score / 375, 4), 1) AS match_confidence FROM scores"))
def pair_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scores(records(spark, sf_dir), Config(merge_threshold=130))
    return scored.select("seq_a", "seq_b", "is_match", confidence.match_confidence(F.col("total_score"), F.lit(375)).alias("match_confidence"))


@query(over("SELECT a.seq AS seq_a, b.seq AS seq_b, 1 AS linkedin, CAST(a.seq % 2 = b.seq % 2 AS INT) AS education FROM people a JOIN people b ON a.person = b.person AND a.seq < b.seq WHERE a.seq % 5 <> 4 AND b.seq % 5 <> 4"))
def profile_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LinkedIn and education signals of pairs that share a LinkedIn page; of five records four state it."""
    r = records(spark, sf_dir)
    person = people(spark, sf_dir).select("seq", "person")
    page = F.when(F.col("seq") % 5 != 4, F.concat(F.lit("https://www.linkedin.com/in/p-"), F.col("person").cast("string"), F.lit("/")))
    study = F.struct(F.concat(F.lit("School "), (F.col("seq") % 2).cast("string")).alias("institution"), *(F.lit(None).cast("string").alias(k) for k in ("degree", "field_of_study", "start_date", "end_date")))
    more = r.join(person, "seq").withColumn("links", F.col("links").withField("linkedin", page)).withColumn("education", F.array(study).cast(RAW_EDUCATION)).drop("person")
    feats = resolve.features(more)
    keys = resolve.block_keys(feats).where("key_type = 'linkedin'")
    holds = lambda s: F.exists("signals", lambda x: x["signal_type"] == s).cast("int")
    return resolve.score_pairs(resolve.block_pairs(keys), feats).select("seq_a", "seq_b", holds("linkedin_match").alias("linkedin"), holds("education_overlap").alias("education"))


@query(whole(CLUSTERS_SQL, "SELECT seq, cluster_id FROM clusters"))
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cluster(records(spark, sf_dir))


@query(whole(f"{KEYS_SQL}, {SCORE_SQL}, {clusters_sql('SELECT seq_a, seq_b FROM scores WHERE total_score >= 130 AND strong')}", "SELECT seq, cluster_id FROM clusters"))
def clusters_by_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.cluster(records(spark, sf_dir), Config(merge_threshold=130))


# --- merging

RANK_SQL = "CAST(CASE source_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(Config().trust_hierarchy)) + f" ELSE {len(Config().trust_hierarchy)} END AS BIGINT)"
RANKED_SQL = f"{CLUSTERS_SQL}, r AS (SELECT p.*, c.cluster_id, {RANK_SQL} AS rank FROM people p JOIN clusters c ON c.seq = p.seq)"


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, clusters), both written: rounds and outputs read them again and again."""
    r = materialise(records(spark, sf_dir))
    return r, materialise(resolve.cluster(r))


def _explained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, clusters, scores) with the features and pairs that clusters and scores share."""
    r = materialise(records(spark, sf_dir))
    feats, pairs = resolve.candidate_pairs(r)
    return r, materialise(resolve.cluster(r, candidates=(feats, pairs))), resolve.score_pairs(pairs, feats, stars=True)


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    r, c = _resolved(spark, sf_dir)
    return c, *merge.merge(r, c)


def _scored(r: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles with their confidence, provenance), both written."""
    p, log = merge.merge(r, c)
    log = materialise(log)
    return materialise(confidence.score_profiles(p, log)), log


@query(
    whole(
        RANKED_SQL,
        f"SELECT cluster_id, arg_min({NAME_SQL.format('full_name')}, rank * 1000000000 + seq) AS full_name, CAST(arg_min(yoe, rank * 1000000000 + seq) AS DOUBLE) AS years_experience, "
        f"min(CASE WHEN github IS NOT NULL THEN 'https://github.com/user-' || person END) AS github, count(*) AS n_records FROM r GROUP BY cluster_id",
    )
)
def merge_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    return p.select("cluster_id", "full_name", "years_experience", F.col("links.github").alias("github"), F.size("merged_from").cast("bigint").alias("n_records"))


@query(
    whole(
        RANKED_SQL + ", l AS (SELECT cluster_id, arg_min(struct_pack(city := city, country := country), rank * 1000000000 + seq) AS x FROM r WHERE city IS NOT NULL OR country IS NOT NULL GROUP BY cluster_id)",
        f"SELECT DISTINCT r.cluster_id, CASE x.city WHEN 'Mumbai' THEN 'Mumbai' WHEN 'new-york' THEN 'New-York' WHEN 'HYDERABAD' THEN 'Hyderabad' END AS city, {COUNTRY_SQL.format('x.country')} AS country FROM r LEFT JOIN l ON l.cluster_id = r.cluster_id",
    )
)
def merge_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    return p.select("cluster_id", "location.city", "location.country")


@query(
    whole(
        RANKED_SQL + f", e AS (SELECT cluster_id, lower(email) AS v, min(seq) AS s FROM r WHERE email IS NOT NULL GROUP BY ALL), ph AS (SELECT cluster_id, {PHONE_SQL.format('phone')} AS v, min(seq) AS s FROM r WHERE phone IS NOT NULL GROUP BY ALL)",
        "SELECT c.cluster_id, coalesce((SELECT string_agg(v, ',' ORDER BY s) FROM e WHERE e.cluster_id = c.cluster_id), '') AS emails, coalesce((SELECT string_agg(v, ',' ORDER BY s) FROM ph WHERE ph.cluster_id = c.cluster_id), '') AS phones FROM (SELECT DISTINCT cluster_id FROM r) c",
    )
)
def merge_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    return p.select("cluster_id", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"))


BASE_SQL = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in Config().source_base_scores.items()) + " ELSE 0.5 END"
SKILLS_SQL = f"sk AS (SELECT cluster_id, lower(v) AS k, arg_min(v, seq) AS v, max(c) AS c, min(seq) AS s FROM (SELECT cluster_id, seq, {SKILL_SQL.format('skill')} AS v, {BASE_SQL} AS c FROM r) GROUP BY cluster_id, lower(v))"


@query(whole(f"{RANKED_SQL}, {SKILLS_SQL}", "SELECT cluster_id, string_agg(v, ',' ORDER BY c DESC, s) AS skills, CAST(max(c) AS DOUBLE) AS best FROM sk GROUP BY cluster_id"))
def merge_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    return p.select("cluster_id", F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"), F.array_max(F.transform("skills", lambda s: s["confidence"])).alias("best"))


@query(whole(RANKED_SQL + ", x AS (SELECT cluster_id, 'Company ' || (person % 4 + seq % 2) AS v, min(seq) AS s FROM r GROUP BY ALL)", "SELECT cluster_id, string_agg(v, ',' ORDER BY s) AS companies, '2020-01' AS start, 'present' AS end FROM x GROUP BY cluster_id"))
def dedup_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    first = F.get("experience", F.lit(0))
    return p.select("cluster_id", F.array_join(F.transform("experience", lambda e: e["company"]), ",").alias("companies"), first["start"].alias("start"), first["end"].alias("end"))


IDS_SQL = """ids AS (SELECT DISTINCT cluster_id, unnest(['email:' || lower(email), 'phone:' || regexp_replace(phone, '[^0-9]', '', 'g'), 'github:' || lower(github)]) AS k FROM r),
  seeds AS (SELECT r.cluster_id, coalesce((SELECT string_agg(k, '|' ORDER BY k COLLATE "C") FROM ids WHERE ids.cluster_id = r.cluster_id AND k IS NOT NULL), 'name:' || string_agg(DISTINCT lower(full_name), '|' ORDER BY lower(full_name) COLLATE "C")) AS seed FROM r GROUP BY r.cluster_id),
  h AS (SELECT cluster_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(seed)) AS h FROM seeds),
  cids AS (SELECT cluster_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], ['8', '9', 'a', 'b'][1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4] || h[18:20], h[21:32]) AS candidate_id FROM h)""".replace(' COLLATE "C"', "")


@query(whole(f"{RANKED_SQL}, {IDS_SQL}", "SELECT cluster_id, candidate_id FROM cids"))
def candidate_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    return p.select("cluster_id", "candidate_id")


# provenance of the person relation: one row a field but one a distinct email, phone and company, and one a skill mention
PROVENANCE_SQL = f"""{IDS_SQL},
  single AS (SELECT cluster_id, field, arg_min(source_type, o) AS source, c AS confidence FROM (
      SELECT cluster_id, 'full_name' AS field, source_type, rank * 1000000000 + seq AS o, 0.95 AS c FROM r UNION ALL
      SELECT cluster_id, 'location', source_type, rank * 1000000000 + seq, 0.85 FROM r WHERE city IS NOT NULL OR country IS NOT NULL UNION ALL
      SELECT cluster_id, 'links.github', source_type, seq, 0.95 FROM r WHERE github IS NOT NULL UNION ALL
      SELECT cluster_id, 'years_experience', source_type, rank * 1000000000 + seq, 0.80 FROM r) GROUP BY cluster_id, field, c),
  listed AS (SELECT cluster_id, field, arg_min(source_type, seq) AS source, c AS confidence FROM (
      SELECT cluster_id, 'emails' AS field, lower(email) AS v, source_type, seq, 0.95 AS c FROM r WHERE email IS NOT NULL UNION ALL
      SELECT cluster_id, 'phones', {PHONE_SQL.format("phone")}, source_type, seq, 0.90 FROM r WHERE phone IS NOT NULL UNION ALL
      SELECT cluster_id, 'experience.Company ' || (person % 4 + seq % 2), 'x', source_type, seq, 0.85 FROM r) GROUP BY cluster_id, field, v, c),
  prov AS (SELECT x.*, cids.candidate_id FROM (SELECT * FROM single UNION ALL SELECT * FROM listed UNION ALL SELECT cluster_id, 'skills.' || {SKILL_SQL.format("skill")}, source_type, {BASE_SQL} FROM r) x JOIN cids ON cids.cluster_id = x.cluster_id),
  fc AS (SELECT candidate_id, string_split(field, '.')[1] AS field, CAST(least(max(CAST(confidence AS DECIMAL(18,8))) + CAST(0.05 AS DECIMAL(18,8)) * (count(DISTINCT source) - 1), 1) AS DECIMAL(18,8)) AS confidence FROM prov GROUP BY candidate_id, string_split(field, '.')[1])"""


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}", "SELECT candidate_id, field, source, CAST(confidence AS DOUBLE) AS confidence FROM prov"))
def provenance_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, log = _merged(spark, sf_dir)
    return log.select("candidate_id", "field", "source", "confidence")


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}", "SELECT candidate_id, field, CAST(count(DISTINCT source) AS BIGINT) AS source_count, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM prov GROUP BY candidate_id, field"))
def provenance_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, log = _merged(spark, sf_dir)
    return provenance.explain(log).select("candidate_id", "field", "source_count", F.array_join("sources", ",").alias("sources"))


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}", "SELECT candidate_id, field, round(CAST(confidence AS DOUBLE), 4) AS confidence FROM fc"))
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, log = _merged(spark, sf_dir)
    return confidence.field_confidences(log).select("candidate_id", "field", F.col("confidence").cast("double").alias("confidence"))


_WEIGHT_SQL = case_of({k: str(v) for k, v in FIELD_WEIGHTS.items()}, "field")
OVERALL_SQL = f"""
  base AS (SELECT candidate_id, CAST(sum(confidence * CAST({_WEIGHT_SQL} AS INT)) / 100 AS DECIMAL(18,8)) AS base FROM fc GROUP BY candidate_id),
  place AS (SELECT cluster_id, arg_min(struct_pack(city := city, country := country), rank * 1000000000 + seq) AS x FROM r WHERE city IS NOT NULL OR country IS NOT NULL GROUP BY cluster_id),
  cov AS (SELECT cluster_id, 4 + max((email IS NOT NULL)::INT) + max((phone IS NOT NULL)::INT) + max((github IS NOT NULL)::INT) AS filled FROM r GROUP BY cluster_id),
  src AS (SELECT candidate_id, count(DISTINCT source) AS n FROM prov GROUP BY candidate_id),
  overall AS (SELECT c.cluster_id, filled + CASE WHEN x.city IS NOT NULL OR ({COUNTRY_SQL.format("x.country")}) IS NOT NULL THEN 1 ELSE 0 END AS filled, base, n
    FROM cov c JOIN cids USING (cluster_id) JOIN base USING (candidate_id) JOIN src USING (candidate_id) LEFT JOIN place USING (cluster_id)),
  final AS (SELECT cluster_id, filled, round(CAST(least(base * filled / 10 + least(CAST(0.05 AS DECIMAL(18,8)) * n, 0.15), 1) AS DOUBLE) + 1e-12, 4) AS overall FROM overall)"""


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}, {OVERALL_SQL}", "SELECT cluster_id, CAST(filled AS DOUBLE) / 10 AS coverage, overall, CASE WHEN overall >= 0.85 THEN 'high' WHEN overall >= 0.6 THEN 'medium' ELSE 'low' END AS tier FROM final"))
def overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored, _ = _scored(*_resolved(spark, sf_dir))
    return scored.select("cluster_id", confidence.coverage(scored).cast("double").alias("coverage"), F.col("overall_confidence").alias("overall"), confidence.tier(F.col("overall_confidence")).alias("tier"))


@query(
    whole(
        f"{RANKED_SQL}, {PROVENANCE_SQL}, {OVERALL_SQL}, n AS (SELECT candidate_id, source, count(*) AS n FROM prov GROUP BY ALL)",
        "SELECT cids.candidate_id, f.overall, CAST(filled AS DOUBLE) / 10 AS coverage, (SELECT string_agg(source || ':' || n, ',' ORDER BY source) FROM n WHERE n.candidate_id = cids.candidate_id) AS contributions, "
        "(SELECT CAST(sum(n) AS BIGINT) FROM n WHERE n.candidate_id = cids.candidate_id) AS records, (SELECT CAST(confidence AS DOUBLE) FROM fc WHERE fc.candidate_id = cids.candidate_id AND field = 'skills') AS skills, 0.0::DOUBLE AS headline FROM final f JOIN cids USING (cluster_id)",
    )
)
def confidence_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each profile's confidence by field and source; no record states a headline."""
    scored, log = _scored(*_resolved(spark, sf_dir))
    parts = F.transform(F.map_entries("source_contributions"), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string")))
    field = F.col("field_confidences")
    return confidence.breakdown(scored, log).select(
        "candidate_id", F.col("overall_confidence").alias("overall"), "coverage", F.array_join(F.array_sort(parts), ",").alias("contributions"),
        F.col("total_provenance_records").alias("records"), field["skills"].alias("skills"), field["headline"].alias("headline"),
    )


METHOD_SQL = f"CASE WHEN field LIKE 'skills.%' THEN coalesce({case_of(SKILL_METHODS, 'source')}, 'inferred') WHEN field IN ('full_name', 'years_experience') AND (SELECT count(*) FROM r WHERE r.cluster_id = prov.cluster_id) > 1 THEN 'conflict_resolution' ELSE 'direct_assertion' END"


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}", f"SELECT field, source, {METHOD_SQL} AS method, count(*) AS n FROM prov GROUP BY ALL"))
def provenance_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, log = _merged(spark, sf_dir)
    return log.groupBy("field", "source", "method").agg(F.count("*").alias("n"))


@query(whole(f"{RANKED_SQL}, {PROVENANCE_SQL}", "SELECT CASE WHEN candidate_id = (SELECT min(candidate_id) FROM cids) THEN 'renamed' ELSE candidate_id END AS candidate_id, source, CAST(confidence AS DOUBLE) AS confidence FROM prov WHERE field = 'full_name'"))
def provenance_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stated each profile's name, the profile with the smallest id under another one."""
    _, p, log = _merged(spark, sf_dir)
    smallest = p.agg(F.min("candidate_id")).first()[0]
    changed = provenance.rekey(log, smallest, "renamed") if smallest is not None else log
    return provenance.history(changed, field="full_name").select("candidate_id", "source", "confidence")


@query(whole(RANKED_SQL, "SELECT cluster_id, source_type AS source, count(*) AS n FROM r GROUP BY cluster_id, source_type"))
def source_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return r.join(resolve.cluster(r), "seq").groupBy("cluster_id", F.col("source_type").alias("source")).agg(F.count("*").alias("n"))


@query(whole(RANKED_SQL + f", best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rank, seq) AS k, count(*) OVER (PARTITION BY cluster_id) AS n FROM r)", f"SELECT cluster_id, n > 1 AS conflict, {NAME_SQL.format('full_name')} AS chosen, source_type AS source, CASE WHEN n > 1 THEN 'Source ''' || source_type || ''' has highest trust rank (' || rank || ')' END AS reason, CAST(n - 1 AS INT) AS rejected FROM best WHERE k = 1"))
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    stated = r.join(resolve.cluster(r), "seq").select("cluster_id", "seq", "source_type", names.normalize_name(F.col("full_name")).alias("value"))
    return merge.resolution("full_name", stated).select("cluster_id", "conflict", F.col("chosen_value").alias("chosen"), F.col("chosen_source").alias("source"), F.col("chosen_reason").alias("reason"), F.size("rejected").alias("rejected"))


# --- output


@query(
    whole(
        RANKED_SQL + ", e AS (SELECT cluster_id, lower(email) AS v, min(seq) AS s FROM r WHERE email IS NOT NULL GROUP BY ALL)",
        "SELECT cluster_id, (SELECT arg_min(v, s) FROM e WHERE e.cluster_id = c.cluster_id) AS first_email, CAST(NULL AS VARCHAR) AS tenth_email, CAST(NULL AS VARCHAR) AS missing FROM (SELECT DISTINCT cluster_id FROM r) c",
    )
)
def project_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    config = {"fields": [{"path": "key", "from": "cluster_id"}, {"path": "contact.email", "from": "emails[0]"}, {"path": "contact.tenth", "from": "emails[10]"}, {"path": "missing", "from": "nowhere.at.all"}]}
    out = projection.project(p, config)
    return out.select(F.col("key").alias("cluster_id"), F.col("contact.email").alias("first_email"), F.col("contact.tenth").alias("tenth_email"), "missing")


@query(whole(f"{RANKED_SQL}, {SKILLS_SQL}", "SELECT cluster_id, string_agg(v, ',' ORDER BY c DESC, s) AS skill_names FROM sk GROUP BY cluster_id"))
def project_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, p, _ = _merged(spark, sf_dir)
    out = projection.project(p, {"fields": [{"path": "cluster_id", "from": "cluster_id"}, {"path": "skill_names", "from": "skills[*].name"}, {"path": "gone", "from": "nope"}], "on_missing": "skip"})
    return out.select("cluster_id", F.array_join("skill_names", ",").alias("skill_names"))


@query(whole(CLUSTERS_SQL + ", s AS (SELECT cluster_id, count(*) AS n FROM clusters GROUP BY cluster_id)", "SELECT count(*) AS total_profiles, CAST(sum(CAST(n > 1 AS INT)) AS BIGINT) AS clusters_with_merges, round((sum(n) - count(*)) / sum(n) * 100, 6) AS dedup_rate FROM s"))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    c = materialise(resolve.cluster(r))
    n = c.agg(F.count("*").alias("n"))
    return report.summary(c).crossJoin(n).select("total_profiles", "clusters_with_merges", F.round(confidence.dedup_rate(F.col("n"), F.col("total_profiles")), 6).alias("dedup_rate"))


@query()
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole profiles with their confidence, as JSON."""
    p, log = _scored(*_resolved(spark, sf_dir))
    return projection.to_json(projection.project(p, {"include_confidence": True, "include_provenance": True}, log))


@query()
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every profile's explanation as text."""
    r, c, scores = _explained(spark, sf_dir)
    p, _ = _scored(r, c)
    return report.candidate_text(report.candidates(p, c, scores))


@query(
    whole(
        f"{RANKED_SQL}, firsts AS (SELECT key_type, key, min(seq) AS f FROM keys GROUP BY key_type, key), stars AS (SELECT DISTINCT f, seq FROM keys JOIN firsts USING (key_type, key) WHERE f < seq), m AS (SELECT cluster_id, count(*) AS n FROM stars JOIN clusters USING (seq) GROUP BY cluster_id)",
        "SELECT r.cluster_id, count(*) > 1 AS merged, count(*) AS record_count, CAST(coalesce(any_value(m.n), 0) AS INT) AS n_matches FROM r LEFT JOIN m ON m.cluster_id = r.cluster_id GROUP BY r.cluster_id",
    )
)
def report_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explains each profile's merge: its records and their matches with the first of a block."""
    r, c, scores = _explained(spark, sf_dir)
    p, _ = merge.merge(r, c)
    e = F.col("merge_explanation")
    return report.candidates(p, c, scores).select("cluster_id", e["merged"].alias("merged"), e["record_count"].alias("record_count"), F.size(e["match_details"]).alias("n_matches"))


@query(over("SELECT seq, coalesce(nullif(trim(lower(regexp_replace(coalesce(CASE WHEN seq % 11 > 0 THEN full_name END, 'r' || seq), '[^\\p{L}\\p{N}]', '_', 'g')), '_'), ''), 'r' || seq) AS stem FROM people"))
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of people; every eleventh without a name."""
    fallback = F.concat(F.lit("r"), F.col("seq").cast("string"))
    return people(spark, sf_dir).select("seq", file_stem(F.when(F.col("seq") % 11 > 0, F.col("full_name")), fallback).alias("stem"))
