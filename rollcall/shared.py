"""Tables in the cluster's shared folder, which cut lineage and survive lost executors, and how many tasks rows are dealt to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on one machine, as in tests.
FALLBACK_CHECKPOINT_DIR = "/tmp/checkpoints"
#: Rows of a task at most, and those that are worth one while cores are idle.
TASK_ROWS, LEAST_ROWS = 20_000, 1_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = FALLBACK_CHECKPOINT_DIR
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rollcall/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(rows: DataFrame) -> int:
    """Into how many tasks as many rows as these are dealt.

    Spark sizes tasks by bytes, and a row of a few bytes, as in a compressed file, may stand for a whole profile's work.
    Counts the rows: cheap for a written table.
    """
    n = rows.count()
    return max(1, -(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS))
