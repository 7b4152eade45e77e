"""Sinks that replace what a scope held before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_scopes(rows: DataFrame, folder: str, scope: str, scopes: list) -> None:
    """Make `rows` all that the table at `folder`, partitioned by `scope`, holds of the given scopes; other scopes stay as they are.

    The new partitions are written aside and put in place when all tasks are done, so a run that fails leaves the old rows, and a
    rerun gives the same table. A scope that has no rows any more loses its partition last. Rows of other scopes are an error,
    found before anything is replaced.
    """
    allowed = F.col(scope).isin(*[s for s in scopes if s is not None]) | (F.col(scope).isNull() if None in scopes else F.lit(False))
    told = F.concat(F.lit(f"{scope} is not among the scopes to replace: "), F.coalesce(F.col(scope).cast("string"), F.lit("null")))
    checked = rows.withColumn(scope, F.when(F.coalesce(allowed, F.lit(False)), F.col(scope)).otherwise(F.raise_error(told).cast(dict(rows.dtypes)[scope])))
    checked.repartition(scope, F.pmod(F.xxhash64(*rows.columns), F.lit(32))).write.partitionBy(scope).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
    present = {r[0] for r in rows.select(scope).distinct().collect()}  # no more values than scopes
    for gone in set(scopes) - present:
        drop_scope(rows.sparkSession, folder, scope, gone)


def drop_scope(spark: SparkSession, folder: str, scope: str, value) -> None:
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(scope, None if value is None else str(value))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        store.delete(where, True)
