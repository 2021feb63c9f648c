"""Projections of every JSON source to raw records.

A projection maps a variant column to a struct of the record's fields. ``present`` keys stop at a null,
``given`` keys pass over it: sources differ in this.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import blank_to_null, strip
from ..schema import LINKS, RAW_EDUCATION, RAW_EXPERIENCE
from .variants import at, elements, first_text, full_name, given, is_list, is_object, is_text, number, only_text, present, text, text_list, truthy

# The names that resumes use for each field, in order.
RESUME = {
    "full_name": ["full_name", "name", "fullName", "candidate_name", "candidateName"],
    "emails": ["emails", "email", "email_addresses", "emailAddresses"],
    "phones": ["phones", "phone", "phone_numbers", "phoneNumbers", "mobile"],
    "headline": ["headline", "summary", "title", "objective", "professional_summary"],
    "years": ["years_experience", "yearsExperience", "experience_years", "total_experience", "totalExperience", "years_of_experience"],
    "skills": ["skills", "skill_list", "skillList", "technical_skills", "technicalSkills", "core_skills"],
    "experience": ["experience", "work_experience", "workExperience", "employment", "positions", "work_history"],
    "education": ["education", "educations", "academic", "qualifications"],
    "location": ["location", "address", "geo", "geography"],
    "links": ["links", "profiles", "urls", "social"],
}


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def location(city: Column, region: Column, country: Column) -> Column:
    return F.struct(city.alias("city"), region.alias("region"), country.alias("country"))


def links(linkedin: Column, github: Column, portfolio: Column, other: Column | None = None) -> Column:
    other = F.array().cast("array<string>") if other is None else other
    return F.struct(linkedin.alias("linkedin"), github.alias("github"), portfolio.alias("portfolio"), other.alias("other")).cast(LINKS)


def record(**fields: Column) -> Column:
    """A struct of the projected fields; those not given are null or empty."""
    empty = {"emails": "array<string>", "phones": "array<string>", "skills": "array<string>", "experience": RAW_EXPERIENCE, "education": RAW_EDUCATION}
    whole = {k: F.coalesce(fields[k], F.array().cast(kind)) if k in fields else F.array().cast(kind) for k, kind in empty.items()}
    single = {"full_name": none(), "location": location(none(), none(), none()), "links": links(none(), none(), none()), "headline": none(), "years_experience": none("double"), "github_username": none()}
    return F.struct(*(c.alias(k) for k, c in (single | fields | whole).items()))


def place(parts: Column, region_from: int, country_from: int) -> Column:
    """City, region and country of a comma-separated place; region and country if there are that many parts."""
    n = F.size(parts)
    return location(F.get(parts, F.lit(0)), F.when(n >= region_from, F.get(parts, F.lit(1))), F.when(n >= country_from, F.get(parts, n - 1)))


def comma_parts(x: Column) -> Column:
    return F.transform(F.split(x, ","), strip)


def date_text(v: Column) -> Column:
    """{year, month} as YYYY-MM, {year} as YYYY, anything else as its text."""
    year, month = text(at(v, "year")), F.try_variant_get(at(v, "month"), "$", "int")
    composed = F.when(month > 0, F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))).otherwise(year)
    return F.when(is_object(v), composed).otherwise(text(v))


def job(company: Column, title: Column, start: Column, end: Column, description: Column) -> Column:
    return F.struct(company.alias("company"), title.alias("title"), start.alias("start_date"), end.alias("end_date"), description.alias("description"))


def study(institution: Column, degree: Column, field: Column, start: Column, end: Column) -> Column:
    return F.struct(institution.alias("institution"), degree.alias("degree"), field.alias("field_of_study"), start.alias("start_date"), end.alias("end_date"))


def objects(v: Column, shape) -> Column:
    """``shape`` of each object of a list."""
    return F.transform(F.filter(elements(v), is_object), shape)


def linkedin(v: Column) -> Column:
    where = present(v, "location", "locationName")
    structured = location(text(at(where, "city")), first_text(text(at(where, "region")), text(at(where, "state"))), first_text(text(at(where, "country")), text(at(where, "countryCode"))))
    flat = location(text(at(v, "city")), text(present(v, "region", "state")), text(present(v, "country", "countryCode")))
    skills = F.transform(elements(at(v, "skills")), lambda s: F.when(is_object(s), text(at(s, "name"))).otherwise(text(s)))
    return record(
        full_name=full_name(v, ["full_name", "fullName"], ["firstName", "first_name"], ["lastName", "last_name"]),
        emails=text_list(present(v, "emailAddress", "email")),
        phones=text_list(present(v, "phone", "phoneNumbers")),
        headline=text(present(v, "headline", "title")),
        location=F.when(is_object(where), structured).when(is_text(where) & (strip(text(where)) != ""), place(comma_parts(text(where)), 2, 3)).otherwise(flat),
        links=links(text(present(v, "publicProfileUrl", "profile_url", "linkedin_url")), text(present(v, "github", "github_url")), text(present(v, "website", "portfolio"))),
        skills=F.filter(skills, lambda s: s.isNotNull() & (s != "")),
        experience=objects(
            present(v, "positions", "experience"),
            lambda p: job(text(present(p, "companyName", "company")), text(present(p, "title", "position")), date_text(present(p, "startDate", "start_date")), date_text(present(p, "endDate", "end_date")), text(present(p, "description", "summary"))),
        ),
        education=objects(
            present(v, "educations", "education"),
            lambda e: study(text(present(e, "schoolName", "institution", "school")), text(present(e, "degree", "degreeName")), text(present(e, "fieldOfStudy", "field_of_study", "major")), date_text(present(e, "startDate", "start_date")), date_text(present(e, "endDate", "end_date"))),
        ),
        years_experience=number(present(v, "years_experience", "yearsExperience")),
    )


def resume(v: Column) -> Column:
    names = RESUME
    where, urls = given(v, *names["location"]), given(v, *names["links"])
    structured = location(
        text(at(where, "city")), first_text(*(text(at(where, k)) for k in ("region", "state", "province"))), first_text(*(text(at(where, k)) for k in ("country", "country_code")))
    )
    flat = location(text(given(v, "city")), text(given(v, "region", "state", "province")), text(given(v, "country", "country_code", "countryCode")))
    own = links(text(at(urls, "linkedin")), text(at(urls, "github")), first_text(text(at(urls, "portfolio")), text(at(urls, "website"))), text_list(at(urls, "other")))
    single = links(text(given(v, "linkedin", "linkedin_url", "linkedinUrl")), text(given(v, "github", "github_url", "githubUrl")), text(given(v, "portfolio", "website", "portfolio_url")))
    return record(
        full_name=text(given(v, *names["full_name"])),
        emails=text_list(given(v, *names["emails"])),
        phones=text_list(given(v, *names["phones"])),
        headline=text(given(v, *names["headline"])),
        location=F.when(is_object(where), structured).otherwise(flat),
        links=F.when(is_object(urls), own).otherwise(single),
        skills=text_list(given(v, *names["skills"])),
        # dates of resumes count as strings only
        experience=objects(given(v, *names["experience"]), lambda e: job(text(at(e, "company")), text(at(e, "title")), only_text(at(e, "start_date")), only_text(at(e, "end_date")), text(at(e, "description")))),
        education=objects(
            given(v, *names["education"]),
            lambda e: study(first_text(text(at(e, "institution")), text(at(e, "school"))), text(at(e, "degree")), first_text(text(at(e, "field_of_study")), text(at(e, "major"))), only_text(at(e, "start_date")), only_text(at(e, "end_date"))),
        ),
        years_experience=number(given(v, *names["years"])),
    )


def ats(v: Column) -> Column:
    urls, social = at(v, "links"), present(v, "socialProfiles", "social_profiles")
    link = lambda k: text(F.coalesce(at(urls, k), at(v, k), at(social, k)))
    listed = lambda one, many: F.when(truthy(one), text_list(one)).otherwise(F.when(is_list(many), text_list(many)))
    where = at(v, "location")
    ends = lambda e: F.when(truthy(at(e, "current")) | truthy(at(e, "is_current")), F.lit("present")).otherwise(only_text(present(e, "endDate", "end_date")))
    return record(
        full_name=full_name(v, ["full_name", "fullName"], ["first_name", "firstName"], ["last_name", "lastName"]),
        emails=listed(present(v, "email", "email_address", "emailAddress"), at(v, "emails")),
        phones=listed(present(v, "phone", "phone_number", "phoneNumber"), at(v, "phones")),
        headline=text(present(v, "headline", "role", "title")),
        # a state is not read: only city, region and country are
        location=location(text(at(where, "city")), text(at(where, "region")), text(at(where, "country"))),
        links=links(link("linkedin"), link("github"), link("portfolio"), text_list(at(urls, "other"))),
        skills=F.filter(F.transform(elements(at(v, "skills")), only_text), lambda s: s.isNotNull()),
        experience=objects(at(v, "experience"), lambda e: job(text(at(e, "company")), text(at(e, "title")), only_text(present(e, "startDate", "start_date")), ends(e), text(present(e, "description", "summary")))),
        education=objects(at(v, "education"), lambda e: study(text(present(e, "institution", "school")), text(at(e, "degree")), text(present(e, "field_of_study", "field", "major")), none(), text(present(e, "graduationYear", "graduation_year", "end_date")))),
        years_experience=none("double"),
    )


def hr(v: Column) -> Column:
    skills = present(v, "skills", "competencies")
    one = lambda *keys: F.filter(F.array(text(present(v, *keys))), lambda x: x.isNotNull() & (x != ""))
    return record(
        full_name=full_name(v, ["full_name", "name", "employee_name"], ["first_name", "firstName"], ["last_name", "lastName"]),
        emails=one("email", "work_email", "corporate_email"),
        phones=one("phone", "mobile", "work_phone"),
        headline=text(present(v, "title", "job_title", "designation")),
        location=location(text(present(v, "city", "office_city")), text(present(v, "state", "region")), text(present(v, "country", "country_code"))),
        links=links(text(at(v, "linkedin")), text(at(v, "github")), none()),
        skills=F.when(is_text(skills), F.filter(comma_parts(text(skills)), lambda s: s != "")).otherwise(F.when(is_list(skills), text_list(skills))),
        years_experience=number(present(v, "years_experience", "tenure_years")),
    )


def language_histogram(repos: Column) -> Column:
    """map language -> repositories, languages in order of first mention."""
    languages = F.filter(F.transform(elements(repos), lambda r: only_text(at(r, "language"))), lambda x: x.isNotNull() & (x != ""))
    names = F.array_distinct(languages)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.size(F.filter(languages, lambda x: x == n))))


def topic_set(repos: Column) -> Column:
    """Distinct topics in alphabetical order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(elements(repos), lambda r: F.when(is_list(at(r, "topics")), text_list(at(r, "topics"))).otherwise(F.array().cast("array<string>"))))))


def github(v: Column) -> Column:
    profile = F.coalesce(at(v, "profile"), v)
    repos = present(v, "repos", "repositories")
    where = only_text(at(profile, "location"))
    return record(
        full_name=text(at(profile, "name")),
        emails=F.filter(F.array(text(at(profile, "email"))), lambda x: x.isNotNull() & (x != "")),
        headline=text(at(profile, "bio")),
        location=F.when(strip(where) != "", place(comma_parts(where), 3, 2)).otherwise(location(none(), none(), none())),
        links=links(none(), text(present(profile, "html_url", "github_url")), blank_to_null(text(at(profile, "blog")))),
        skills=F.concat(F.map_keys(language_histogram(repos)), topic_set(repos)),
        github_username=text(at(profile, "login")),
    )


def members(v: Column, *keys: str) -> Column:
    """A root list's objects, else those of the first of ``keys`` that is a list, else the object itself."""
    nested = F.coalesce(*(F.when(is_list(at(v, k)), elements(at(v, k))) for k in keys))
    return F.filter(F.when(is_list(v), elements(v)).otherwise(F.coalesce(nested, F.array(v))), is_object)


#: source type -> (members of a document, projection)
PROJECTIONS = {
    "linkedin_json": (lambda v: F.filter(F.array(v), is_object), linkedin),
    "github": (lambda v: F.filter(F.array(v), is_object), github),
    "hr_system": (lambda v: members(v, "employees", "records", "candidates"), hr),
    "resume_json": (lambda v: F.filter(F.array(v), is_object), resume),
    "ats_json": (lambda v: members(v, "candidates", "records", "results"), ats),
}
