"""Finding sources and naming their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DISCOVERED = "seq bigint, path string, is_file boolean"

# First parts of GitHub paths that are fetched as no user.
NO_USERS = ["features", "pricing", "about", "explore", "marketplace", "topics", "trending", "login", "signup"]


def is_url(path: str) -> bool:
    return path.startswith(("http://", "https://")) or "github.com/" in path or "linkedin.com/" in path


def discover(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq, path, is_file): URLs as they are, files, and the files below folders in order of their paths; dot files are left out.

    Listing goes through the file system of each path, so that any store Spark reads will do. What is not
    there is passed over.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows: list[tuple[str, bool]] = []
    for given in paths:
        if is_url(given):
            rows.append((given, False))
            continue
        path = jvm.org.apache.hadoop.fs.Path(given)
        system = path.getFileSystem(conf)
        if not system.exists(path):
            continue
        if system.getFileStatus(path).isFile():
            rows.append((system.makeQualified(path).toString(), True))
            continue
        found, files = [], system.listFiles(path, True)
        while files.hasNext():
            at = files.next().getPath()
            if not at.getName().startswith("."):
                found.append(at.toString())
        rows += [(p, True) for p in sorted(found)]
    return spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(rows)], DISCOVERED)


def source_type(path: Column) -> Column:
    """The kind of a source by its path or URL; the first that fits. Null: no source reads it."""
    lower = F.lower(path)
    name = F.regexp_extract(lower, r"([^/]*)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    json, url = name.endswith(".json"), lower.rlike(r"^(https?://|www\.)")
    has = lambda *words: stem.rlike("|".join(words))
    return (
        F.when(lower.rlike(r"linkedin\.com/(in|profile)/") | (json & has("linkedin")), "linkedin_json")
        .when(lower.contains("github.com/") | (json & has("github")), "github")
        .when(json & has("hr", "employee", "internal"), "hr_system")
        .when(json & has("resume", "cv"), "resume_json")
        .when(name.endswith(".csv"), "ats_csv")
        .when(json & has("ats"), "ats_json")
        .when(name.endswith(".pdf"), "pdf")
        .when(url & ~lower.rlike(r"linkedin\.com|github\.com"), "portfolio_web")
    )
