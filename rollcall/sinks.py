"""Writing a run's results."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import report
from .plans.pipeline import Result


def file_stem(name: Column, fallback: Column) -> Column:
    """A file name of a person's name: letters and digits, else _; without _ at the ends; the fallback, or unknown, if empty."""
    stem = F.trim(F.lower(F.regexp_replace(F.coalesce(name, fallback, F.lit("")), r"[^\p{L}\p{N}]", "_")), F.lit("_"))
    return F.when(stem != "", stem).otherwise(F.coalesce(fallback, F.lit("unknown")))


def candidate_files(result: Result) -> DataFrame:
    """(file, profile, report, text) by cluster: file names with the JSON and text that go into them."""
    names = result.profiles.select("cluster_id", "candidate_id", file_stem(F.col("full_name"), F.col("candidate_id")).alias("file"))
    whole = result.profiles.select("cluster_id", F.to_json(F.struct(*[c for c in result.profiles.columns if c != "cluster_id"]), {"ignoreNullFields": "false"}).alias("profile"))
    own = result.candidates.select("cluster_id", F.to_json(F.struct("candidate_id", "full_name", "overall_confidence", "merge_explanation"), {"ignoreNullFields": "false"}).alias("report"))
    texts = report.candidate_text(result.candidates)
    return names.join(whole, "cluster_id").join(own, "cluster_id", "left").join(texts, "candidate_id", "left").orderBy("cluster_id").select("file", "profile", "report", "text")


def write_candidates(result: Result, folder: str, *, text: bool = False) -> None:
    """A JSON file and a report per profile in a local folder, row by row; of equal names the last stays.

    For many profiles write ``result.output`` with Spark's own writers instead.
    """
    os.makedirs(folder, exist_ok=True)
    for row in candidate_files(result).toLocalIterator():
        for suffix, content in (("", row["profile"]), ("_report", row["report"])):
            if content is not None:
                with open(os.path.join(folder, f"{row['file']}{suffix}.json"), "w", encoding="utf-8") as f:
                    f.write(content)
        if text and row["text"] is not None:
            with open(os.path.join(folder, f"{row['file']}_report.txt"), "w", encoding="utf-8") as f:
                f.write(row["text"])


def report_rows(result: Result) -> DataFrame:
    """(part, at, json): the summary and then each candidate."""
    head = result.summary.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at"), F.to_json(F.struct("*")).alias("json"))
    body = result.candidates.select(F.lit(1).alias("part"), F.col("cluster_id").alias("at"), F.to_json(F.struct("candidate_id", "full_name", "overall_confidence", "merge_explanation"), {"ignoreNullFields": "false"}).alias("json"))
    return head.union(body).orderBy("part", "at")


def write_report_json(result: Result, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for i, row in enumerate(report_rows(result).toLocalIterator()):
            f.write(f'{{"summary":{row["json"]},"candidates":[' if i == 0 else ("," if i > 1 else "") + row["json"])
        f.write("]}")


def write_report_text(result: Result, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        for row in report.run_text(result.candidates, result.summary).orderBy("part", "at").toLocalIterator():
            f.write(row["text"] + "\n")


def write_table(df: DataFrame, path: str, *, form: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Any of a run's tables by Spark's writers."""
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).format(form).save(path)
