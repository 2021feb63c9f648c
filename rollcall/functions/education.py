"""Education entries in a resume's text: section, entries and their parts, as column expressions.

The section's lines are folded into entries with ``aggregate``; an entry is then rewritten by rules in order
and cut at its degree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import blank_to_null, bound, squeeze, strip, title_case

# Headings, words of table heads, of degrees and of institutions, and the signs of grades.
HEADING = r"(?iU)\b(?:education|academic|academics|qualifications|scholastic)\b"
NEXT_HEADING = r"(?iU)\b(?:projects|experience|work|employment|positions|achievements|skills|profiles|languages|certifications)\b"
TABLE_HEAD = ["degree", "specialization", "institute", "year", "cpi", "gpa", "marks", "grade", "percentage", "board"]
DEGREES = [
    "b.tech", "btech", "m.tech", "mtech", "intermediate", "ssc", "b.s.", "bs", "m.s.", "ms", "b.e.", "be", "bachelor", "master", "ph.d", "phd",
    "diploma", "high school", "secondary school", "secondary", "xstandard", "x standard", "10th", "12th", "cbse", "icse", "tsbie",
]
ENTRY_PLACES = ["college", "university", "school", "institute", "academy", "polytechnic", "sri chaitanya", "srichaitanya", "iare", "iaer"]
CUT_PLACES = ["griet", "college", "university", "institute", "school", "sri chaitanya", "srichaitanya", "iit", "nit", "bits", "iiit"]
MONTH = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+|\d{1,2}/)?"
RANGE = rf"(?i)\b({MONTH}\d{{4}})\s*-\s*({MONTH}(?:present|\d{{4}}))\b"
SINGLE = rf"(?i)\b({MONTH}\d{{4}})\b"
NUMBER = r"\d{1,3}(?:\.\d{1,2})?"
#: Rewriting before dates are taken out, and after.
SPACING = [
    (r"\]([A-Za-z])", "] $1"), (r"(?i)([A-Za-z]+)college", "$1 college"), (r"(?i)([A-Za-z]+)school", "$1 school"), (r"([A-Za-z]+)in([A-Z])", "$1 in $2"),
    (r"([A-Za-z]+)and([A-Z])", "$1 and $2"), (r"([A-Za-z]+)of([A-Z])", "$1 of $2"), ("([a-z])([A-Z])", "$1 $2"),
    ("([A-Z])([A-Z][a-z])", "$1 $2"), ("[–—�]+", "-"), ("&", " & "), (",", ", "),
]
GRADES = [
    (rf"(?i)\b(?:gpa|cgpa|cpi|aggregate|marks|percentage|score|grade)\b[\s:]*(?:{NUMBER}\s*/?\s*{NUMBER}%?|{NUMBER}%?)?", ""),
    (r"\b\d{1,3}\s*/\s*\d{1,3}\b", ""), (rf"/\s*{NUMBER}%?", ""), (rf"\b{NUMBER}%", ""),
    (r"(?iU)\b\w*(?:percent|cgpa|gpa|cpi|marks|grade|score|current)\w*\b[\s:]*", ""), (r"\s*-\s*", " "),
]
#: Canonical names of degrees, by what their word holds; others are in title case.
DEGREE_NAMES = [
    (r"b\.tech|btech", "B.Tech"), (r"m\.tech|mtech", "M.Tech"), ("intermediate", "Intermediate"), ("ssc", "SSC"),
    ("secondary|xstandard|x standard|10th", "SSC (10th Standard)"),
]


def any_of(words: list[str]) -> str:
    return "(?i)" + "|".join(w.replace(".", r"\.") for w in words)


def rewritten(x: Column, rules: list[tuple[str, str]]) -> Column:
    return reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, x)


def section(text: Column) -> Column:
    """Lines between the first short line with HEADING and the next short line with NEXT_HEADING, without blank ones."""
    lines = F.transform(F.split(text, "\n"), strip)
    heads = F.transform(lines, lambda x: x.rlike(HEADING) & (F.length(x) < 30))
    rest = F.slice(lines, F.array_position(heads, True).cast("int") + 1, F.greatest(F.size(lines), F.lit(1)))
    rest = F.filter(rest, lambda x: x != "")
    stop = F.array_position(F.transform(rest, lambda x: x.rlike(NEXT_HEADING) & (F.length(x) < 30)), True).cast("int")
    body = F.when(stop > 0, F.slice(rest, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(rest)
    heading_words = lambda x: sum((F.lower(x).contains(w).cast("int") for w in TABLE_HEAD), F.lit(0))
    found = F.array_position(heads, True) > 0
    return F.when(found, F.filter(body, lambda x: heading_words(x) < 3)).otherwise(F.array().cast("array<string>"))


def entries(lines: Column) -> Column:
    """Lines joined to entries. A line opens a new one if it repeats the open one's year or degree, or names a place after either."""
    year = lambda x: x.rlike(r"(?U)\b\d{4}\b")
    degree = lambda x: x.rlike(any_of(DEGREES))
    place = lambda x: x.rlike(any_of(ENTRY_PLACES))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("year"), F.lit(False).alias("degree"))

    def step(state: Column, line: Column) -> Column:
        opens = (state["open"] != "") & ((year(line) & state["year"]) | (degree(line) & state["degree"]) | (place(line) & (state["year"] | state["degree"])))
        return F.struct(
            F.when(opens, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"]).alias("done"),
            F.when(opens | (state["open"] == ""), line).otherwise(F.concat(state["open"], F.lit(" "), line)).alias("open"),
            (year(line) | (state["year"] & ~opens)).alias("year"),
            (degree(line) | (state["degree"] & ~opens)).alias("degree"),
        )

    return F.aggregate(lines, start, step, lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def parsed(entry: Column) -> Column:
    """struct(institution, degree, field_of_study, start_date, end_date) of one entry."""
    spaced = squeeze(rewritten(entry, SPACING))

    def dated(x: Column) -> Column:
        ranged = x.rlike(RANGE)
        start = F.when(ranged, strip(F.regexp_extract(x, RANGE, 1)))
        tail = strip(F.regexp_extract(x, RANGE, 2))
        end = F.when(ranged, F.concat(F.upper(F.substring(tail, 1, 1)), F.lower(F.substr(tail, F.lit(2))))).otherwise(blank_to_null(strip(F.regexp_extract(x, SINGLE, 1))))
        left = F.replace(x, F.when(ranged, F.regexp_extract(x, RANGE, 0)).otherwise(F.regexp_extract(x, SINGLE, 0)), F.lit(""))
        line = squeeze(rewritten(F.when(ranged | x.rlike(SINGLE), left).otherwise(x), GRADES))
        return bound(F.struct(line.alias("line"), start.alias("start"), end.alias("end")), cut)

    def cut(x: Column) -> Column:
        line = x["line"]
        longest = sorted(DEGREES, key=len, reverse=True)
        patterns = [r"(?iU)\b" + d.replace(".", r"\.") + r"\b" for d in longest]
        word = F.coalesce(*(blank_to_null(F.regexp_extract(line, p, 0)) for p in patterns))
        at = F.instr(F.lower(line), F.lower(word))
        after = F.substr(line, at + F.length(word))
        again = F.instr(F.lower(after), F.lower(word))
        field = strip(F.when(again > 0, F.substr(after, F.lit(1), again - 1)).otherwise(after))
        named = reduce(lambda out, rule: out.when(F.lower(word).rlike(rule[0]), rule[1]), DEGREE_NAMES[1:], F.when(F.lower(word).rlike(DEGREE_NAMES[0][0]), DEGREE_NAMES[0][1])).otherwise(title_case(word))
        with_degree = F.struct(F.regexp_replace(strip(F.substr(line, F.lit(1), at - 1)), "[, \\-&]+$", "").alias("institution"), named.alias("degree"), field.alias("field"))

        words = F.split(line, " ")
        rest = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
        place = F.array_min(F.filter(F.array(*(F.instr(F.lower(rest), w) for w in CUT_PLACES)), lambda i: i > 0))
        half = F.floor(F.size(words) / 2).cast("int")
        by_place = F.struct(strip(F.substr(rest, place)).alias("institution"), F.get(words, F.lit(0)).alias("degree"), F.regexp_replace(strip(F.substr(rest, F.lit(1), place - 1)), "[, \\-&]+$", "").alias("field"))
        by_half = F.struct(F.array_join(F.slice(words, half + 1, F.size(words)), " ").alias("institution"), F.get(words, F.lit(0)).alias("degree"), F.array_join(F.slice(words, F.lit(2), F.greatest(half - 1, F.lit(0))), " ").alias("field"))
        short = F.struct(blank_to_null(rest).alias("institution"), blank_to_null(F.get(words, F.lit(0))).alias("degree"), F.lit(None).cast("string").alias("field"))
        parts = F.when(word.isNotNull(), with_degree).when(place.isNotNull(), by_place).when(F.size(words) >= 3, by_half).otherwise(short)

        def shaped(p: Column) -> Column:
            study = strip(F.regexp_replace(p["field"], r"(?i)^(?:in\s+)+", ""))
            study = F.regexp_replace(F.regexp_replace(study, "^[() ]+|[() ]+$", ""), r"\.+$", "")
            return F.struct(p["institution"].alias("institution"), p["degree"].alias("degree"), F.when(study != "-", blank_to_null(study)).alias("field_of_study"), x["start"].alias("start_date"), x["end"].alias("end_date"))

        return bound(parts, shaped)

    return bound(spaced, dated)


def education(text: Column) -> Column:
    """Education entries of a resume's text; empty without a section of that heading."""
    return F.coalesce(F.transform(entries(section(text)), parsed), F.array())
