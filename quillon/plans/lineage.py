"""Cut the lineage of iterative plans through the folder that driver and executors share."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave it unset, it gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-cut-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as a table of the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def turns(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """cut for the state of a loop, in two folders by turns: a table stays until the one after the next is written.

    The shuffle files of each write go with it; else they stay until the driver happens to collect its garbage.
    """
    path, turn, gone = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}", itertools.count(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def put(df: DataFrame) -> DataFrame:
        where, before = f"{path}-{next(turn) % 2}", spark.conf.get(gone)
        spark.conf.set(gone, "true")
        try:
            df.write.mode("overwrite").parquet(where)
        finally:
            spark.conf.set(gone, before)
        return spark.read.schema(df.schema).parquet(where)

    return put
