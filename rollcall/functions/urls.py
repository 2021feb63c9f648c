"""URLs: normal form, user names and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank_to_null, strip

# Paths of github.com that are no users.
RESERVED = [
    "features", "pricing", "about", "explore", "marketplace", "topics", "trending", "collections", "events", "sponsors", "settings",
    "notifications", "login", "signup", "join", "enterprise", "team", "organizations", "orgs",
]
# What makes a host a portfolio.
PORTFOLIO_MARKS = "portfolio|personal|blog|dev\\.|\\.dev"


def normalize_url(url: Column) -> Column:
    """https://host/path: lower-cased host without www., no closing slash, parameters, query or fragment; null without a host."""
    x = F.regexp_replace(strip(url), r"[\t\r\n]", "")
    x = F.when(x.rlike("(?i)^https?://"), F.regexp_replace(x, "(?i)^https?://", "")).otherwise(x)
    host = F.regexp_replace(F.lower(F.regexp_extract(x, r"^([^/?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(x, r"^[^/?#]*([^?#]*)", 1), r";[^/]*$", "")
    return F.when((strip(url) != "") & (F.regexp_extract(x, r"^([^/?#]*)", 1) != ""), F.concat(F.lit("https://"), host, F.regexp_replace(path, "/+$", "")))


def linkedin_username(url: Column) -> Column:
    return blank_to_null(F.regexp_extract(normalize_url(url), r"(?i)linkedin\.com/in/([^/?#]+)", 1))


def github_username(url: Column, reserved: list[str] | None = None) -> Column:
    """The first path element on github.com unless it is reserved."""
    name = blank_to_null(F.regexp_extract(normalize_url(url), r"(?i)github\.com/([^/?#]+)", 1))
    return F.when(~F.lower(name).isin(RESERVED if reserved is None else reserved), name)


def classify_url(url: Column) -> Column:
    """linkedin, github, portfolio or other; null without a host."""
    x = normalize_url(url)
    return (
        F.when(x.isNull(), None)
        .when(F.lower(x).contains("linkedin.com/in/"), "linkedin")
        .when(F.lower(x).contains("github.com/"), "github")
        .when(F.lower(x).rlike(PORTFOLIO_MARKS), "portfolio")
        .otherwise("other")
    )
