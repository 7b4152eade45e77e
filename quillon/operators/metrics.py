"""Usage metrics over an append-only log of queries.

`usage` gives any event table the log's shape: ts, dev, query, hit, latency. Aggregations take an optional half-open time
range. All are partial aggregates followed by one shuffle of the groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import table

TOKENS_PER_HIT, COST_PER_1000, TOKENS_PER_QUERY, RANGES = 5000, 0.003, 35, 64


def usage(events: DataFrame) -> DataFrame:
    """ts, dev, query, hit and latency of events: the key in props is the query, a click a cache hit."""
    return events.select(
        "event_id", "ts", F.col("user_id").alias("dev"), F.get_json_object("props", "$.k").alias("query"),
        (F.col("event_type") == "click").alias("hit"), F.col("value").alias("latency"), "event_type",
    )


def between(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with start <= ts < end; a missing bound is open."""
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    return rows if end is None else rows.filter(F.col("ts") < F.to_timestamp_ntz(F.lit(end)))


def totals(rows: DataFrame) -> DataFrame:
    """Queries, hits, hit rate (0 without queries), distinct developers, tokens saved and their cost."""
    got = rows.agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"), F.countDistinct("dev").alias("devs"))
    saved = F.col("hits") * TOKENS_PER_HIT
    rate = F.when(F.col("queries") > 0, F.round(F.col("hits") / F.col("queries"), 6)).otherwise(F.lit(0.0))
    return got.select("queries", "hits", "devs", rate.alias("hit_rate"), saved.alias("tokens_saved"), F.round(saved * COST_PER_1000 / 1000, 6).alias("cost_saved"))


def by_day(rows: DataFrame, days: int | None = None) -> DataFrame:
    """Queries and hits a day; with `days`, of that many days before the newest row."""
    if days is not None:
        newest = rows.agg(F.max("ts")).scalar()
        rows = rows.filter(F.col("ts") >= newest - F.expr(f"INTERVAL {days} DAYS"))
    return rows.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))


def by_developer(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("dev").isNotNull()).groupBy("dev").agg(F.count("*").alias("queries"), F.count_if("hit").alias("hits"))


def top_queries(rows: DataFrame, limit: int = 10) -> DataFrame:
    return rows.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(limit)


def recent_queries(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Per query: cards seen, their names in order, last time and count; the newest first."""
    names = F.array_join(F.array_sort(F.collect_set("event_type")), ",")
    got = rows.groupBy("query").agg(F.countDistinct("event_type").alias("cards"), names.alias("titles"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    return got.orderBy(F.desc("last_seen"), "query").limit(limit)


def latency_percentiles(rows: DataFrame, key: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Values at rank floor(n * p) of each group's sorted values, with count and mean.

    Ranks come from counts of equal values. A group's values are cut into RANGES of about as many each (by approximate
    quantiles, which decide no result), so that a window is over a range's values or over a group's ranges.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("k"))
    bounds = counts.groupBy(key).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("bounds"))
    ranged = counts.join(bounds, key).withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col(value)))).drop("bounds")
    sums = ranged.groupBy(key, "range").agg(F.sum("k").alias("held"))
    before = F.sum("held").over(Window.partitionBy(key).orderBy("range")) - F.col("held")
    bases = sums.select(key, "range", before.alias("base"), F.sum("held").over(Window.partitionBy(key)).alias("n"))
    placed = ranged.join(bases, [key, "range"]).withColumn("end", F.col("base") + F.sum("k").over(Window.partitionBy(key, "range").orderBy(value)))
    out = [F.max("n").alias("n"), F.round(F.sum(F.col(value) * F.col("k")) / F.max("n"), 4).alias("mean")]
    for p in points:
        rank = F.floor(F.col("n") * p)
        out.append(F.max(F.when((F.col("end") > rank) & (F.col("end") - F.col("k") <= rank), F.col(value))).alias(f"p{round(p * 100)}"))
    return placed.groupBy(key).agg(*out)


def telemetry(rows: DataFrame) -> DataFrame:
    """One report an instance (event type): queries, active developers, hit rate, tokens."""
    rate = F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("queries"), F.countDistinct("dev").alias("devs"), F.round(rate, 6).alias("hit_rate"),
        F.round(F.avg(F.coalesce("latency", F.lit(0.0))), 4).alias("mean_latency"), (F.count("*") * TOKENS_PER_QUERY).alias("tokens"),
    )


def cross_instance(rows: DataFrame, days: int = 7) -> DataFrame:
    """Over instances (developers): how many, how many active in the last days, mean of their hit rates."""
    newest = rows.agg(F.max("ts")).scalar()
    each = rows.groupBy("dev").agg(F.max("ts").alias("seen"), F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)).alias("rate"), F.count("*").alias("queries"))
    active = F.col("seen") >= F.col("newest") - F.expr(f"INTERVAL {days} DAYS")
    return each.withColumn("newest", newest).agg(
        F.count("*").alias("instances"), F.count_if(active).alias("active"), F.sum("queries").alias("queries"), F.round(F.avg("rate"), 6).alias("mean_rate")
    )


def rate_windows(rows: DataFrame, minutes: int = 1440, most: int = 5) -> DataFrame:
    """Calls of each developer and tumbling window; over: those beyond the allowance."""
    got = rows.groupBy("dev", F.window(F.col("ts").cast("timestamp"), f"{minutes} minutes").alias("w")).agg(F.count("*").alias("calls"))
    start = F.to_timestamp_ntz(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss"))
    return got.select("dev", start.alias("window_start"), "calls", F.greatest(F.col("calls") - most, F.lit(0)).alias("over"))


def stats(rows: DataFrame) -> DataFrame:
    """Hit percentage to two places, a row for each event type."""
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if("hit") / F.count("*"), 2).alias("hit_pct"))


def seats(rows: DataFrame, limit: int | None = 100) -> DataFrame:
    """Developers by state (active: over ten queries) against a limit; no limit: null."""
    each = rows.groupBy("dev").agg(F.count("*").alias("n"))
    used = F.count_if(F.col("n") > 10)
    return each.agg(used.alias("active"), F.count("*").alias("detected"), F.lit(limit).cast("long").alias("seat_limit"), (used > F.lit(limit)).alias("over_limit"))


def benchmark_projects(rows: DataFrame) -> DataFrame:
    """Per project: means, success-only mean, reduction in percent and rate."""
    good = F.when(F.col("hit"), F.col("latency"))
    return rows.groupBy(F.col("event_type").alias("project")).agg(
        F.count("*").alias("queries"), F.round(F.avg("latency"), 4).alias("mean_all"), F.round(F.avg(good), 4).alias("mean_success"),
        F.floor(100 * (1 - F.sum(F.least("latency", F.lit(50.0))) / F.sum("latency")) + 0.5).alias("reduction_pct"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("success_rate"),
    )


def benchmark_total(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count("*").alias("projects"), F.sum("queries").alias("queries"), F.round(F.avg("mean_all"), 3).alias("mean_all"), F.round(F.avg("reduction_pct"), 3).alias("reduction_pct"))


def _log(s, d):
    return usage(table(s, d, "events"))


QUERIES = {
    "metrics_totals": lambda s, d: totals(_log(s, d)),
    "metrics_totals_ranged": lambda s, d: totals(between(_log(s, d), "2024-01-08 00:00:00", "2024-01-20 12:00:00")),
    "queries_by_day": lambda s, d: by_day(_log(s, d)),
    "queries_by_recent_day": lambda s, d: by_day(_log(s, d), 10),
    "dev_stats": lambda s, d: by_developer(_log(s, d)),
    "top_queries": lambda s, d: top_queries(_log(s, d)),
    "recent_queries": lambda s, d: recent_queries(_log(s, d)),
    "latency_percentiles": lambda s, d: latency_percentiles(_log(s, d), "event_type", "latency"),
    "telemetry_rollup": lambda s, d: telemetry(_log(s, d)),
    "telemetry_instances": lambda s, d: cross_instance(_log(s, d)),
    "rate_limit_windows": lambda s, d: rate_windows(_log(s, d)),
    "stats_resource": lambda s, d: stats(_log(s, d)),
    "seat_usage": lambda s, d: seats(_log(s, d)),
    "benchmark_projects": lambda s, d: benchmark_projects(_log(s, d)),
    "benchmark_total": lambda s, d: benchmark_total(benchmark_projects(_log(s, d))),
}

_U = "u AS (SELECT event_id, ts, user_id AS dev, json_extract_string(props, '$.k') AS query, event_type = 'click' AS hit, value AS latency, event_type FROM events)"
_TOTALS = """SELECT count(*) AS queries, count(*) FILTER (hit) AS hits, count(DISTINCT dev) AS devs,
 CASE WHEN count(*) > 0 THEN round(count(*) FILTER (hit) / count(*), 6) ELSE 0 END AS hit_rate,
 count(*) FILTER (hit) * 5000 AS tokens_saved, round(count(*) FILTER (hit) * 5000 * 0.003::DOUBLE / 1000, 6) AS cost_saved FROM u"""
_PROJECTS = """SELECT event_type AS project, count(*) AS queries, round(avg(latency), 4) AS mean_all, round(avg(latency) FILTER (hit), 4) AS mean_success,
 floor(100 * (1 - sum(least(latency, 50.0)) / sum(latency)) + 0.5)::BIGINT AS reduction_pct, round(avg(hit::INT), 6) AS success_rate FROM u GROUP BY 1"""
SQL = {
    "metrics_totals": f"WITH {_U} {_TOTALS}",
    "metrics_totals_ranged": f"WITH {_U} {_TOTALS} WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20 12:00:00'",
    "queries_by_day": f"WITH {_U} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS queries, count(*) FILTER (hit) AS hits FROM u GROUP BY 1",
    "queries_by_recent_day": f"WITH {_U} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS queries, count(*) FILTER (hit) AS hits FROM u WHERE ts >= (SELECT max(ts) FROM u) - INTERVAL 10 DAYS GROUP BY 1",
    "dev_stats": f"WITH {_U} SELECT dev, count(*) AS queries, count(*) FILTER (hit) AS hits FROM u WHERE dev IS NOT NULL GROUP BY 1",
    "top_queries": f"WITH {_U} SELECT query, count(*) AS n FROM u GROUP BY 1 ORDER BY n DESC, query LIMIT 10",
    "recent_queries": f"WITH {_U} SELECT query, count(DISTINCT event_type) AS cards, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS titles, max(ts) AS last_seen, count(*) AS n FROM u GROUP BY 1 ORDER BY last_seen DESC, query LIMIT 20",
    "latency_percentiles": f"WITH {_U} SELECT event_type, count(latency) AS n, round(avg(latency), 4) AS mean, list_sort(list(latency))[floor(count(*) * 0.5)::INT + 1] AS p50, list_sort(list(latency))[floor(count(*) * 0.95)::INT + 1] AS p95, list_sort(list(latency))[floor(count(*) * 0.99)::INT + 1] AS p99 FROM u WHERE latency IS NOT NULL GROUP BY 1",
    "telemetry_rollup": f"WITH {_U} SELECT event_type, count(*) AS queries, count(DISTINCT dev) AS devs, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(coalesce(latency, 0)), 4) AS mean_latency, count(*) * 35 AS tokens FROM u GROUP BY 1",
    "telemetry_instances": f"WITH {_U}, e AS (SELECT dev, max(ts) AS seen, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS q FROM u GROUP BY 1) SELECT count(*) AS instances, count(*) FILTER (seen >= (SELECT max(ts) FROM u) - INTERVAL 7 DAYS) AS active, sum(q)::BIGINT AS queries, round(avg(rate), 6) AS mean_rate FROM e",
    "rate_limit_windows": f"WITH {_U} SELECT dev, date_trunc('day', ts) AS window_start, count(*) AS calls, greatest(count(*) - 5, 0) AS over FROM u GROUP BY 1, 2",
    "stats_resource": f"WITH {_U} SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (hit) / count(*), 2) AS hit_pct FROM u GROUP BY 1",
    "seat_usage": f"WITH {_U}, e AS (SELECT dev, count(*) AS n FROM u GROUP BY 1) SELECT count(*) FILTER (n > 10) AS active, count(*) AS detected, 100::BIGINT AS seat_limit, count(*) FILTER (n > 10) > 100 AS over_limit FROM e",
    "benchmark_projects": f"WITH {_U} {_PROJECTS}",
    "benchmark_total": f"WITH {_U}, p AS ({_PROJECTS}) SELECT count(*) AS projects, sum(queries)::BIGINT AS queries, round(avg(mean_all), 3) AS mean_all, round(avg(reduction_pct), 3) AS reduction_pct FROM p",
}
