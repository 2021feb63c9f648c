"""From paths to raw records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tables import read_taxonomy, skill_aliases
from ..functions.text import strip_html
from ..functions.urls import github_username
from ..schema import RECORD, conform, ddl
from ..shared import materialise
from . import csv_records, remote, text_records
from .discover import NO_USERS, discover, source_type
from .json_records import PROJECTIONS


def numbered(rows: DataFrame, record: Column, place: Column, source: Column, path: Column, first: Column, place_bits: int = 40) -> DataFrame:
    """Records with ids, made of path and place, and ``seq``: the source's number above 2^place_bits, the place below."""
    out = rows.select(record.alias("r"), place.cast("bigint").alias("place"), source.alias("source_type"), path.alias("source_path"), first.cast("bigint").alias("first"))
    out = out.select(
        F.substring(F.sha2(F.concat_ws("|", "source_path", F.col("place").cast("string")), 256), 1, 32).alias("record_id"),
        (F.shiftleft("first", place_bits) + F.col("place")).alias("seq"), "source_type", "source_path", "r.*",
    )
    return conform(out, RECORD)


def json_records(documents: DataFrame, place_bits: int = 40) -> DataFrame:
    """Records of JSON documents (seq, path, source_type, document). Broken JSON gives none."""
    parsed = documents.withColumn("v", F.try_parse_json("document"))
    parts = []
    for kind, (members, project) in PROJECTIONS.items():
        own = parsed.where(F.col("source_type") == kind).select("seq", "path", "source_type", F.posexplode(members(F.col("v"))).alias("place", "m"))
        parts.append(numbered(own, project(F.col("m")), F.col("place"), F.col("source_type"), F.col("path"), F.col("seq"), place_bits))
    return reduce(DataFrame.unionByName, parts)


def rejected(documents: DataFrame) -> DataFrame:
    """(path, reason) of JSON documents that can't be parsed."""
    return documents.where(F.try_parse_json("document").isNull()).select("path", F.when(F.trim("document") == "", "empty").otherwise("malformed JSON").alias("reason"))


def read_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(seq, path, source_type, document) of whole text files named in ``files``."""
    paths = [r["path"] for r in files.select("path").collect()]  # of the size of the file listing, which is made on the driver
    if not paths:
        return spark.createDataFrame([], "seq bigint, path string, source_type string, document string")
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("document"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return whole.join(files.withColumn("key", plain(F.col("path"))), plain(F.col("at")) == F.col("key")).select("seq", "path", "source_type", "document")


def ingest(spark: SparkSession, paths: list[str], config: Config | None = None, transport: remote.Transport | None = None) -> DataFrame:
    """Raw records of files, folders and URLs, in ingestion order by ``seq``.

    A source that can't be read gives no records and does not stop the others. URLs are fetched only with a
    ``transport``. No sources at all give an empty result.
    """
    config = config or Config()
    sources = discover(spark, paths).withColumn("source_type", source_type(F.col("path")))
    keywords = sorted(set(skill_aliases(read_taxonomy(config.taxonomy_path)).values()))
    listed = sources.collect()  # of the size of the file listing
    kinds = {(r["source_type"], r["is_file"]) for r in listed}
    parts = [spark.createDataFrame([], ddl(RECORD))]
    if any(kind in PROJECTIONS and is_file for kind, is_file in kinds):
        parts.append(json_records(read_files(spark, sources.where(F.col("is_file") & F.col("source_type").isin(list(PROJECTIONS))))))
    for r in listed:
        if r["source_type"] == "ats_csv" and r["is_file"]:
            rows = csv_records.read_rows(spark, r["path"])
            header = [c for c in rows.columns if c != "_place"]
            projected = rows.select(csv_records.project(header).alias("r"), "_place").where(csv_records.is_useful(F.col("r")))
            parts.append(numbered(projected, F.col("r"), F.col("_place"), F.lit("ats_csv"), F.lit(r["path"]), F.lit(r["seq"])))
    if ("pdf", True) in kinds:
        pdfs = sources.where("is_file and source_type = 'pdf'")
        content = spark.read.format("binaryFile").load([r["path"] for r in listed if r["source_type"] == "pdf" and r["is_file"]]).select("path", "content")
        plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
        texts = text_records.pdf_texts(content).where(F.trim("text") != "").withColumn("key", plain(F.col("path"))).drop("path").join(pdfs.withColumn("key", plain(F.col("path"))), "key")
        parts.append(numbered(texts, text_records.from_resume_text(F.col("text"), keywords), F.lit(0), F.lit("pdf"), F.col("path"), F.col("seq")))
    if transport is not None and any(not is_file for _, is_file in kinds):
        urls = sources.where("not is_file and source_type is not null").withColumn("user", github_username(F.col("path"), NO_USERS)).repartition(max(1, min(64, len(listed))))
        # each kind reads it, and every URL is asked once
        fetched = materialise(remote.fetch(urls, transport, repos=config.max_github_repos, timeout=config.request_timeout_seconds))
        parts.append(json_records(fetched.where("source_type <> 'portfolio_web'")))
        pages = fetched.where("source_type = 'portfolio_web'").withColumn("text", strip_html(F.col("document")))
        parts.append(numbered(pages, text_records.from_portfolio_text(F.col("text"), F.col("path"), keywords), F.lit(0), F.lit("portfolio_web"), F.col("path"), F.col("seq")))
    return reduce(DataFrame.unionByName, parts)
