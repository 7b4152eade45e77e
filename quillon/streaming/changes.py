"""Change feeds with Structured Streaming: debounced batches, latest status, upserts, running counts, rate windows.

Sources are file streams; event time comes from `ts` with a watermark. Every stream has a batch twin in the operators, and
tests compare both on closed windows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import branch_hint, epic_of, sync_level
from quillon.operators.freshness import _B, invalidate_cards, invalidate_docs, named_branches
from quillon.operators.graph import _CARDS, _card_edges, cross_staleness
from quillon.operators.relational import cards_of, upsert_latest
from quillon.session import table

LATE = "10 minutes"


def stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a file stream of its schema, with ts as an event time.

    All files that are there make one batch: they need not be in the order of ts, and rows of later batches that lie
    behind the watermark would be dropped. files_per_batch is for streams without a watermark and for files in order.
    """
    path = f"{sf_dir}/{name}.parquet"
    # a pattern, because a table may be one file and the source takes a plain path for a folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # with no limit, availableNow takes all present files in one batch
    rows = reader.parquet(f"{path[:-1]}[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def watched(changes: DataFrame, extensions: tuple[str, ...], skipped: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """Changes of source files outside skipped directories; contents above a megabyte are taken as empty; a rename is a delete and an add."""
    moves = F.when(F.col("status") == "renamed", F.array(F.struct(F.lit("deleted").alias("status"), F.col("old_path").alias("path")), F.struct(F.lit("added").alias("status"), F.col("path")))).otherwise(F.array(F.struct("status", "path")))
    rows = changes.select("repo", "ts", "content", F.explode(moves).alias("m")).select("repo", "ts", "m.path", "m.status", "content")
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rows = rows.filter(ext.isin(*extensions) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*skipped)))
    return rows.withColumn("content", F.when(F.octet_length("content") > 1 << 20, "").otherwise(F.col("content")))


def debounced(changes: DataFrame, keys: list[str], quiet: str, late: str = LATE) -> DataFrame:
    """Batches of changes that no pause of `quiet` interrupts, a row each when it is closed: size, first and last time."""
    got = changes.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return got.select(*keys, "first", "last", "n")


def last_status(changes: DataFrame, quiet: str, late: str = LATE) -> DataFrame:
    """(repo, path, status, ts) of each batch: a path's last status wins, of several at one time the greatest."""
    return changes.withWatermark("ts", late).groupBy("repo", "path", F.session_window("ts", quiet)).agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("ts")).select("repo", "path", "status", "ts")


def forced(changes: DataFrame, most: int = 500, quiet_ms: int | None = 1200) -> DataFrame:
    """Batches by size or silence: a repository's pending changes are flushed at `most`, or when none came for `quiet_ms`.

    Silence is measured in processing time, so such a stream runs until it is stopped; without quiet_ms it can end.

    State a repository is one number and a time, never the changes themselves.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        import pandas as pd

        n, number = state.get if state.exists else (0, 0)
        out = []
        if state.hasTimedOut:
            if n:
                out.append((key[0], number, n, "quiet"))
            state.remove()
        else:
            for f in frames:
                n += len(f)
                while n >= most:
                    out.append((key[0], number, most, "full"))
                    n, number = n - most, number + 1
            state.update((n, number))
            if quiet_ms is not None:
                state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame(out, columns=["repo", "batch", "n", "why"])

    kind = dict(changes.dtypes)["repo"]
    return changes.groupBy("repo").applyInPandasWithState(step, f"repo {kind}, batch long, n long, why string", "n long, number long", "append", GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def head_changes(events: DataFrame) -> DataFrame:
    """(repo, branch, previous, ts) of events (repo, branch, ts, event_id) that move a repository's head to another branch.

    The state of a repository is its branch and the time of its newest event; what comes later but is older, or names no branch,
    changes nothing. A micro-batch's events of one repository are its changes since the last one.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        branch, newest = state.get if state.exists else (None, -1)
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples():
            if row.at >= newest and row.branch:
                if row.branch != branch:
                    out.append((key[0], row.branch, branch, row.at))
                branch, newest = row.branch, row.at
        state.update((branch, newest))
        yield pd.DataFrame(out, columns=["repo", "branch", "previous", "at"]).astype({"previous": object})

    kind = dict(events.dtypes)["repo"]
    rows = events.select("repo", "branch", F.unix_micros("ts").alias("at"), "event_id")
    got = rows.groupBy("repo").applyInPandasWithState(step, f"repo {kind}, branch string, previous string, at long", "branch string, newest long", "append", GroupStateTimeout.NoTimeout)
    return got.select("repo", "branch", "previous", F.timestamp_micros("at").alias("ts"))


def contexts(heads: DataFrame) -> DataFrame:
    """What is stored of a head that moved: hint, ticket and epic of its branch; sandboxes store nothing."""
    return heads.withColumn("level", sync_level(F.col("branch"))).filter("level <> 'skip'").select(
        "repo", "ts", "branch", "previous", "level", branch_hint(F.col("branch")).alias("hint"), epic_of(F.col("branch")).alias("epic")
    )


def running_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def rate_windows(rows: DataFrame, key: str, width: str = "1 day", late: str = LATE) -> DataFrame:
    return rows.withWatermark("ts", late).groupBy(key, F.window("ts", width)).agg(F.count("*").alias("calls")).select(key, F.col("window.start").alias("start"), "calls")


def finished(rows: DataFrame, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run the stream over all that is there now and return what it wrote, as a table of the shared folder.

    base, a folder of its own in shared storage, lets a later call go on where this one stopped.
    """
    spark = rows.sparkSession
    base = base or _folder(spark)
    if mode == "append":
        rows.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{base}/out")

    # complete mode: each batch replaces the table under its number; the newest whole one is the result
    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out-{number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return _newest(spark, base, rows.schema)


def upserted(rows: DataFrame, keys: list[str], newest: str, base: str | None = None) -> DataFrame:
    """Apply the stream batch by batch, the newest row of each key; what is there at the end.

    A batch builds on the newest table of a lower number that storage holds whole, so that a batch run again after a lost
    driver gives the same table, and a restart from base keeps all that came before.
    """
    spark = rows.sparkSession
    base = base or _folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        old = _newest(spark, base, batch.schema, number)
        upsert_latest(old, batch, keys, newest).write.mode("overwrite").parquet(f"{base}/out-{number}")

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _newest(spark, base, rows.schema)


def stale_by(batch: DataFrame, cards: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key) that a batch of changes (repo, path, merge) makes stale: cards by their files, documents by rule.

    Changes that a merge brought also reach cards of other repositories along interface edges, and changelogs.
    """
    merged = batch.filter("merge")
    own = invalidate_cards(cards, batch).filter("card_state = 'invalidated'").select("id")
    other = cross_staleness(merged.select("path", "repo").distinct(), edges, cards).join(cards.filter(~F.col("stale")).select("id"), "id", "left_semi")
    docs = invalidate_docs(batch).union(invalidate_docs(merged, merge=True)).distinct()
    ids = own.union(other).distinct().select(F.lit("card").alias("kind"), F.col("id").cast("string").alias("key"))
    return ids.union(docs.select(F.lit("doc"), F.concat_ws(":", "repo", "doc_type")))


def synced(changes: DataFrame, cards: DataFrame, edges: DataFrame, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply a stream of changes (repo, path, status, ts, merge) to an empty file index, batch by batch.

    The index holds each file's newest row, deleted ones too, since a late older change must not bring one back; the second
    table holds what became stale, once. Of rows of one time the greatest wins. Both tables go by the batch's number.
    """
    spark = changes.sparkSession
    base = base or _folder(spark)
    kinds = "kind string, key string"

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        gone = _newest(spark, f"{base}/stale", kinds, number)
        gone.union(stale_by(batch, cards, edges)).distinct().write.mode("overwrite").parquet(f"{base}/stale/out-{number}")
        upsert_latest(_newest(spark, base, batch.schema, number), batch, ["repo", "path"], "ts").write.mode("overwrite").parquet(f"{base}/out-{number}")
        batch.unpersist()

    changes.writeStream.foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return _newest(spark, base, changes.schema), _newest(spark, f"{base}/stale", kinds)


def _newest(spark: SparkSession, base: str, schema, below: int | None = None) -> DataFrame:
    """The whole table out-<number> of the greatest number, below a number where one is given; else an empty one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out-*/_SUCCESS")
    done = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    numbers = [int(f.getPath().getParent().getName().rpartition("-")[2]) for f in done]
    numbers = [n for n in numbers if below is None or n < below]
    return spark.read.schema(schema).parquet(f"{base}/out-{max(numbers)}") if numbers else spark.createDataFrame([], schema)


def _folder(spark: SparkSession) -> str:
    from quillon.plans.lineage import shared_folder

    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _changes(s, d) -> DataFrame:
    """Events as changes of the cards' files; errors delete, purchases come by merges."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/g"), (F.col("event_id") % 5).cast("string"))).otherwise(F.concat(F.lit("/en/f"), (F.col("event_id") % 3).cast("string")))
    path = F.concat(F.lit("src"), (k % 40).cast("string"), name)
    status = F.when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return stream(s, d, "events", 8).select(F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repo"), path.alias("path"), status.alias("status"), "ts", (F.col("event_type") == "purchase").alias("merge"))


def _synced(s, d) -> DataFrame:
    index, stale = synced(_changes(s, d), cards_of(table(s, d, "documents")), _card_edges(s, d))
    files = index.filter("status <> 'deleted'").select(F.lit("file").alias("kind"), F.concat_ws(":", "repo", "path").alias("key"))
    return files.union(stale)


def _ntz(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({n: F.to_timestamp_ntz(F.date_format(n, "yyyy-MM-dd HH:mm:ss.SSSSSS")) for n in names})


def _heads(s, d) -> DataFrame:
    return head_changes(named_branches(stream(s, d, "events", 8)))


QUERIES = {
    "stream_head_changes": lambda s, d: _ntz(finished(_heads(s, d)), "ts"),
    "stream_head_context": lambda s, d: _ntz(upserted(contexts(_heads(s, d)), ["repo"], "ts"), "ts"),
    "stream_debounce": lambda s, d: _ntz(finished(debounced(stream(s, d, "events").withColumnRenamed("user_id", "repo"), ["repo"], "30 minutes")), "first", "last"),
    "stream_latest_status": lambda s, d: finished(last_status(stream(s, d, "events").select(F.col("user_id").alias("repo"), F.get_json_object("props", "$.k").alias("path"), F.col("event_type").alias("status"), "ts"), "1 hour")).groupBy("status").agg(F.count("*").alias("n")),
    "stream_usage_counts": lambda s, d: finished(running_counts(stream(s, d, "events", 8), ["user_id", "event_type"]), "complete"),
    "stream_rate_windows": lambda s, d: _ntz(finished(rate_windows(stream(s, d, "events"), "user_id")), "start"),
    "stream_sync": _synced,
    "stream_upsert": lambda s, d: _ntz(upserted(stream(s, d, "events", 8).select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts"), "ts"),
}
# a stream in append mode holds back what the watermark has not closed: windows that end after the newest time less LATE
_HEADS = f"{_B.replace(', ts FROM events', ', ts, event_id FROM events')}, m AS (SELECT repo, branch, lag(branch) OVER (PARTITION BY repo ORDER BY ts, event_id) AS previous, ts FROM b), h AS (SELECT * FROM m WHERE branch IS DISTINCT FROM previous)"
SQL = {
    "stream_head_changes": f"WITH {_HEADS} SELECT * FROM h",
    "stream_head_context": f"WITH {_HEADS} SELECT repo, ts, branch, previous, CASE WHEN branch = 'main' OR branch LIKE 'epic/%' THEN 'full' ELSE 'lightweight' END AS level, CASE WHEN branch LIKE 'feature/%' THEN 'new card' ELSE replace(replace(branch, '-', ' '), '/', ' ') END AS hint, CASE WHEN branch LIKE 'epic/%' THEN replace(substr(branch, 6), '-', ' ') END AS epic FROM h WHERE branch NOT LIKE 'demo/%' QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ts DESC) = 1",
    "stream_debounce": "WITH s AS (SELECT user_id AS repo, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS head FROM events), g AS (SELECT repo, ts, sum(head) OVER (PARTITION BY repo ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT repo, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY repo, k HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES",
    "stream_latest_status": "WITH e AS (SELECT user_id, json_extract_string(props, '$.k') AS path, event_type, ts FROM events), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS head FROM e), g AS (SELECT *, sum(head) OVER (PARTITION BY user_id, path ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s), b AS (SELECT arg_max(event_type, (ts, event_type)) AS status FROM g GROUP BY user_id, path, k HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES) SELECT status, count(*) AS n FROM b GROUP BY 1",
    "stream_sync": f"WITH {_CARDS}, ch AS (SELECT 'repo' || (user_id % 5) AS repo, 'src' || (json_extract_string(props, '$.k')::INT % 40) || CASE WHEN event_id % 2 = 0 THEN '/g' || (event_id % 5) ELSE '/en/f' || (event_id % 3) END AS path, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'modified' END AS status, ts, event_type = 'purchase' AS merge FROM events), i AS (SELECT repo, path, arg_max(status, (ts, status)) AS status FROM ch GROUP BY 1, 2), f AS (SELECT id, repos, unnest(files) AS path FROM c WHERE NOT stale), h AS (SELECT DISTINCT dst AS path, repo FROM ce JOIN ch ON src = ch.path WHERE relation = 'api_endpoint' AND merge) SELECT 'file' AS kind, repo || ':' || path AS key FROM i WHERE status <> 'deleted' UNION ALL (SELECT 'card', id::VARCHAR FROM f WHERE path IN (SELECT path FROM ch) UNION SELECT 'card', id::VARCHAR FROM f JOIN h USING (path) WHERE NOT list_contains(repos, repo))",
    "stream_usage_counts": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_rate_windows": "SELECT user_id, date_trunc('day', ts) AS start, count(*) AS calls FROM events GROUP BY 1, 2 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES",
    "stream_upsert": "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
}
