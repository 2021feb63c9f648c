"""Row types of raw records, profiles and provenance."""

from __future__ import annotations

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
RAW_EXPERIENCE = "array<struct<company:string,title:string,start_date:string,end_date:string,description:string>>"
RAW_EDUCATION = "array<struct<institution:string,degree:string,field_of_study:string,start_date:string,end_date:string>>"

#: A person as one source states it. ``seq`` is the place in ingestion order, which breaks every tie.
RECORD = {
    "record_id": "string", "seq": "bigint", "source_type": "string", "source_path": "string", "full_name": "string",
    "emails": "array<string>", "phones": "array<string>", "location": LOCATION, "links": LINKS, "headline": "string",
    "years_experience": "double", "skills": "array<string>", "experience": RAW_EXPERIENCE, "education": RAW_EDUCATION,
    "github_username": "string",
}

SKILL = "struct<name:string,confidence:double,sources:array<string>>"
EXPERIENCE = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
EDUCATION = "array<struct<institution:string,degree:string,field:string,end_year:string>>"
PROFILE = {
    "candidate_id": "string", "full_name": "string", "emails": "array<string>", "phones": "array<string>", "location": LOCATION, "links": LINKS,
    "headline": "string", "years_experience": "double", "skills": f"array<{SKILL}>", "experience": EXPERIENCE, "education": EDUCATION,
    "overall_confidence": "double", "merged_from": "array<string>",
}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def conform(df, columns: dict[str, str]):
    """``df`` with exactly these columns and types; a missing one is null, an extra one is dropped."""
    from pyspark.sql import functions as F

    return df.select(*((df[name] if name in df.columns else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()))
