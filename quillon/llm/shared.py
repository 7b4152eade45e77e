"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
ROWS = 1 << 18  # rows of a part of a range sort
WORD = r"[^\x20\x09-\x0D]+"

#: in SQL, `tab` has the table of CRC-32 as one list; crc32_sql gives the value of a decimal
CRC_TABLE = """tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(x: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(({x})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir. Only a local session may leave that unset; it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-work-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a table of the work folder and read again: it cuts the lineage and outlives executors."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that stage() returned, when nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def parts_for(rows: int, spark: SparkSession) -> int:
    """Parts of a range sort: ROWS rows each, or fewer where the session has cores to spare."""
    return max(1, -(-rows // ROWS), min(spark.sparkContext.defaultParallelism, rows >> 10))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows (a written table) with `index`, from 0 by the order within their key, and `n`, the key's rows.

    A range sort spreads a hot key over parts. The parts are written with the places of their rows; the rows that a key has in
    earlier parts shift them, and a key has as many counts as there are parts at most.
    """
    sort = rows.repartitionByRange(parts_for(rows.count(), rows.sparkSession), key, *order).sortWithinPartitions(key, *order)
    placed = stage(sort.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    held = placed.groupBy(key, "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = held.select(key, "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy(key)).alias("n"))
    return placed.join(stage(shift, f"{name}-parts"), [key, "part"]).withColumn("index", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def one_of_each(docs: DataFrame, key: dict[str, Column], status: DataFrame) -> DataFrame:
    """One row of docs for each key that status (the key's columns, kept, n) keeps, with the columns of docs.

    n counts the rows of a key. Rows are dealt by key once; only those of repeated keys are dealt again.
    """
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns), F.struct(*(v.alias(k) for k, v in key.items())).alias("__key"))
    kept = status.filter("kept").select(F.struct(*key).alias("__key"), F.col("n").alias("__n"))
    once = keyed.join(kept.filter("__n = 1"), "__key", "left_semi")
    more = keyed.join(kept.filter("__n > 1"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(more).select(*(F.col(f"`{c}`") for c in docs.columns))


def held_out(id_col: str, folds: int, fold: int):
    """Boolean column: the row belongs to the fold that no model may learn from (null ids: never)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, folds: int, fold: int) -> DataFrame:
    """(doc_id, text, label) of at most `bound` labelled rows of each class outside the held-out fold.

    The rows are those with the smallest hash of doc_id, so reruns agree; of an id that documents repeat, the row with the
    smallest hash of its text. The ids that are kept number at most 2 * bound, so that they can be broadcast, and only
    their rows are shuffled.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("doc_id", folds, fold)
    )
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = marked.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        picked = part if picked is None else picked.union(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
