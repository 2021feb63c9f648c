"""CSV exports: columns by alias, rows to raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import blank_to_null, strip
from .json_records import job, links, location, none, record, study

# The headers that name each field.
COLUMNS = {
    "full_name": ["name", "full_name", "fullname", "candidate_name", "candidate"],
    "email": ["email", "email_address", "emailaddress", "e-mail"],
    "phone": ["phone", "phone_number", "phonenumber", "mobile", "telephone", "contact"],
    "skills": ["skills", "skill_list", "technical_skills", "core_skills"],
    "company": ["company", "current_company", "employer", "organization"],
    "title": ["title", "job_title", "position", "role", "designation"],
    "location": ["location", "city", "address"],
    "country": ["country", "country_code"],
    "linkedin": ["linkedin", "linkedin_url", "linkedin_profile"],
    "github": ["github", "github_url", "github_profile"],
    "experience_years": ["experience", "years_experience", "experience_years", "yoe", "total_experience"],
    "education": ["education", "degree", "qualification"],
    "institution": ["institution", "school", "university", "college"],
}


def column_index(header: list[str], columns: dict[str, list[str]] | None = None) -> dict[str, str]:
    """field -> the first header (case aside, blanks as underscores) among its aliases."""
    plain = [(h.strip().lower().replace(" ", "_"), h) for h in header]
    out = {}
    for field, aliases in (columns or COLUMNS).items():
        names = {a.lower() for a in aliases}
        if found := [h for p, h in plain if p in names]:
            out[field] = found[0]
    return out


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header, all columns as text, with ``_place`` in file order. A byte-order mark is dropped; a file that is not UTF-8 is read as Latin-1."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    rows = spark.read.csv(path, encoding="ISO-8859-1" if broken else "UTF-8", header=True, inferSchema=False, multiLine=True, mode="PERMISSIVE", escape='"')
    return rows.withColumn("_place", F.monotonically_increasing_id())


def project(header: list[str], columns: dict[str, list[str]] | None = None) -> Column:
    """A row's record by the header's aliases."""
    index = column_index(header, columns)
    value = lambda field: blank_to_null(strip(F.col(f"`{index[field]}`"))) if field in index else none()
    split = lambda x, signs: F.filter(F.transform(F.split(x, signs), strip), lambda p: p != "")
    company, title, degree, institution = map(value, ("company", "title", "education", "institution"))
    nothing = none()
    return record(
        full_name=value("full_name"),
        emails=split(value("email"), ","),
        phones=F.filter(F.array(value("phone")), lambda p: p.isNotNull()),
        skills=split(value("skills"), "[,;|]"),
        location=location(value("location"), nothing, value("country")),
        links=links(value("linkedin"), value("github"), nothing),
        headline=title,
        years_experience=value("experience_years").try_cast("double"),
        experience=F.when(company.isNotNull() | title.isNotNull(), F.array(job(company, title, nothing, nothing, nothing))),
        education=F.when(degree.isNotNull() | institution.isNotNull(), F.array(study(institution, degree, nothing, nothing, nothing))),
    )


def is_useful(r: Column) -> Column:
    """A name, an email or a phone is there."""
    return r["full_name"].isNotNull() | (F.size(r["emails"]) > 0) | (F.size(r["phones"]) > 0)
