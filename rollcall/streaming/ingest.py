"""JSON documents that arrive in a folder, appended to a table of raw records batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.discover import source_type
from ..sources.ingest import json_records

PLACE_BITS = 31  # of seq: a document's members are an array's; the 32 bits above number the files


def number_files(batch: DataFrame, table: str, epoch: int) -> DataFrame:
    """The batch with ``seq``: its files in order of their paths, after those of all batches before.

    The next file's number is kept below ``_files`` of the table by batch, so that a batch that is run again gets
    the same numbers.
    """
    spark, kept = batch.sparkSession, f"{table}/_files"
    ranks = batch.select("path").distinct().orderBy("path").rdd.map(lambda r: r["path"]).zipWithIndex()
    path = spark._jvm.org.apache.hadoop.fs.Path(kept)
    begin = 0
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        begin = spark.read.schema("next bigint, batch bigint").parquet(kept).where(F.col("batch") < epoch).agg(F.max("next")).first()[0] or 0
    end = begin + ranks.count()
    if end > 1 << (63 - PLACE_BITS):
        raise OverflowError(f"more files than seq can number: {end}")
    spark.range(1).select(F.lit(end).cast("bigint").alias("next")).write.mode("overwrite").parquet(f"{kept}/batch={epoch}")
    return batch.join(spark.createDataFrame(ranks, "path string, rank bigint"), "path").withColumn("seq", F.col("rank") + F.lit(begin)).drop("rank")


def stream_records(spark: SparkSession, folder: str, table: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start a query that reads new JSON files of ``folder`` and writes their records below ``table``.

    A batch overwrites its own partition of the table, so that a batch that is run again leaves no doubles.
    ``once``: end when what is there has been read. ``seq`` numbers records by batch, then by path.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        records = json_records(number_files(batch, table, epoch).withColumn("source_type", source_type(F.col("path"))), PLACE_BITS)
        records.write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    documents = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    writer = documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
