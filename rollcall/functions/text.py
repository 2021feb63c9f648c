"""What free text and HTML say about a person."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank_to_null, bound, squeeze, strip, title_case

# The patterns of what is looked for.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}|\+?\d{10,13}"
LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/[A-Za-z0-9_-]+/?"
URL = r'(?i)https?://[^\s<>"]+|www\.[^\s<>"]+'
PLATFORM = r'(?i)\b(?:leetcode\.com|hackerrank\.com|geeksforgeeks\.com|geeksforgeeks\.org)\b/[^\s<>"]+'
NO_PORTFOLIO = [
    "leetcode.com", "hackerrank.com", "codechef.com", "geeksforgeeks", "hackerearth.com",
    "medium.com", "twitter.com", "x.com", "facebook.com", "instagram.com",
]
NO_NAME = ["resume", "curriculum", "cv", "objective", "summary", "experience", "education", "skills", "phone", "email", "address", "contact"]
YEARS = [
    r"(?i)(\d+)\+?\s*(?:years?|yrs?)[\s.]*(?:of\s+)?(?:experience|exp)",
    r"(?i)(?:experience|exp)[\s:]*(\d+)\+?\s*(?:years?|yrs?)",
    r"(?i)(\d+)\+?\s*(?:years?|yrs?)[\s.]*(?:in\s+(?:the\s+)?(?:industry|field|software))",
]


def find_all(text: Column, pattern: str) -> Column:
    """All matches in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def emails(text: Column) -> Column:
    return F.array_distinct(find_all(text, EMAIL))


def phones(text: Column) -> Column:
    return F.array_distinct(find_all(text, PHONE))


def trimmed_url(url: Column) -> Column:
    return F.regexp_replace(url, "^[/ ]+|[/ ]+$", "")


def links(text: Column) -> Column:
    """struct(linkedin, github, portfolio, other): the first profile links; other URLs, platforms last."""
    plain = F.filter(find_all(text, URL), lambda u: ~F.lower(u).rlike(r"linkedin\.com|github\.com"))
    bare = F.transform(F.transform(find_all(text, PLATFORM), trimmed_url), lambda u: F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://"), u)))
    plain = F.transform(plain, trimmed_url)
    on_platform = lambda u: F.lower(u).rlike("|".join(map(re.escape, NO_PORTFOLIO)))
    urls = bound(plain, lambda p: F.concat(p, F.array_except(bare, p)))
    split = bound(urls, lambda u: F.struct(F.filter(u, lambda x: ~on_platform(x)).alias("own"), F.filter(u, on_platform).alias("platform")))

    def shaped(s: Column) -> Column:
        own = s["own"]
        other = F.concat(F.slice(own, F.lit(2), F.size(own)), s["platform"])
        return F.struct(F.get(find_all(text, LINKEDIN), 0).alias("linkedin"), F.get(find_all(text, GITHUB), 0).alias("github"), F.get(own, 0).alias("portfolio"), other.alias("other"))

    return bound(split, shaped)


def name_guess(text: Column) -> Column:
    """Of the first ten lines, the first of two to four words, two of letters, that is no heading; title case."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), strip)
    lines = F.filter(lines, lambda x: ~F.lower(x).rlike("|".join(NO_NAME)))
    bare = reduce(lambda x, p: F.transform(x, lambda line: F.regexp_replace(line, p, "")), (EMAIL, PHONE, URL), lines)
    parted = F.transform(bare, lambda x: squeeze(F.regexp_replace(x, "([a-z])([A-Z])", "$1 $2")))
    letters = lambda x: F.size(F.filter(F.split(x, " "), lambda w: F.regexp_replace(w, r"\.", "").rlike(r"^\p{L}+$")))
    fits = F.filter(parted, lambda x: F.size(F.split(x, " ")).between(2, 4) & (letters(x) >= 2))
    return title_case(F.get(fits, 0))


def skills_in(text: Column, keywords: list[str]) -> Column:
    r"""The keywords that stand in the text between word boundaries, in the given order.

    One that ends in a sign, as C++, is found before a word character only: a boundary is asked for there too.
    """
    lower = F.lower(text)
    found = F.array(*(F.when(lower.rlike(r"(?U)\b" + re.sub(r"([^\w\s])", r"\\\1", k.lower()) + r"\b"), F.lit(k)) for k in keywords))
    return F.filter(found, lambda k: k.isNotNull()).cast("array<string>")


def years_of_experience(text: Column) -> Column:
    """The number in the first of YEARS that is found."""
    return F.coalesce(*(F.try_to_number(F.regexp_extract(text, p, 1), F.lit("999999999")).cast("double") for p in YEARS))


def strip_html(html: Column) -> Column:
    """Visible text: without scripts, styles, tags and entities, white space as one blank."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    for pattern in ("<[^>]+>", "&[a-zA-Z]+;", r"&#\d+;"):
        x = F.regexp_replace(x, pattern, " ")
    return squeeze(x)


def handle(text: Column, site: str) -> Column:
    """https://<site>/<name> of the first mention; null if there is none."""
    name = blank_to_null(F.regexp_extract(text, "(?i)" + re.sub(r"\.", r"\\.", site) + "/([A-Za-z0-9_-]+)", 1))
    return F.concat(F.lit(f"https://{site}/"), name)
