"""Analytics and retention over query events. ``as_of`` stands for now and is always a parameter."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: range -> (window, bucket) in seconds
RANGES = {"1h": (3600, 300), "24h": (86_400, 3600), "7d": (604_800, 21_600), "30d": (2_592_000, 86_400)}


def _seconds(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def range_filter(events: DataFrame, as_of: Column, key: str) -> DataFrame:
    """Events of the range's window up to ``as_of``, its first moment included."""
    return events.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {RANGES[key][0]} SECONDS"))


def volume_by_route(events: DataFrame, as_of: Column, key: str) -> DataFrame:
    """(bucket, route, n): events by time bucket and route, every bucket from first to last for every route; null routes are unknown."""
    window, size = RANGES[key]
    e = range_filter(events, as_of, key).select((F.floor(_seconds(F.col("created_at")) / size) * size).alias("bucket"), F.coalesce("route", F.lit("unknown")).alias("route"))
    counts = e.groupBy("bucket", "route").agg(F.count("*").alias("n"))
    end = _seconds(as_of)
    dense = counts.select("route").distinct().select("route", F.explode(F.sequence(F.floor((end - window) / size) * size, F.floor(end / size) * size, F.lit(size))).alias("bucket"))
    return dense.join(counts, ["bucket", "route"], "left").select("bucket", "route", F.coalesce("n", F.lit(0)).alias("n"))


def share(events: DataFrame, column: str) -> DataFrame:
    """(column, n, share): count and fraction of all, 4 digits."""
    c = events.groupBy(column).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def overall_totals(events: DataFrame) -> DataFrame:
    n, bad = F.count("*"), F.count_if(F.col("has_error"))
    return events.agg(n.alias("total"), bad.alias("errors"), F.coalesce(F.round(bad / n, 4), F.lit(0.0)).alias("error_rate"), F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"))


def latency_summary(samples: DataFrame, keys: list[str], value: str = "value", order: str = "created_at", ident: str = "id", last: int = 10_000, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Count, mean, quantiles (the element at ``min(n - 1, int(q * n))`` in order) and maximum of the last ``last`` samples of each key."""
    newest = [F.desc(order), F.desc(ident)]
    # A key may hold a third of all samples: its newest are found in parts first, of which only few rows go on.
    parts = samples.withColumn("_part", F.pmod(F.xxhash64(ident), F.lit(64)))
    parts = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*newest))).filter(F.col("_r") <= last)
    recent = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).filter(F.col("_r") <= last)
    w = Window.partitionBy(*keys)
    ranked = recent.withColumn("_i", F.row_number().over(w.orderBy(value, ident)) - 1).withColumn("_n", F.count("*").over(w))
    pick = [F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n"))), F.round(value, 3))).alias(f"p{int(q * 100)}") for q in quantiles]
    return ranked.groupBy(*keys).agg(F.count("*").alias("count"), F.round(F.avg(value), 3).alias("mean"), *pick, F.round(F.max(value), 3).alias("max"))


def recent_failures(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.filter("has_error").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def preview(text: Column, size: int = 160) -> Column:
    """Cut to ``size`` characters, with an ellipsis where something is missing."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def prune(rows: DataFrame, as_of: Column, days: int, stamp: str = "created_at") -> DataFrame:
    """Rows that a retention of ``days`` keeps; 0 or less keeps all, and so do null stamps."""
    return rows if days <= 0 else rows.filter(F.col(stamp).isNull() | (F.col(stamp) >= as_of - F.expr(f"INTERVAL {days} DAYS")))


def reap_stale(jobs: DataFrame, as_of: Column, hours: int = 2) -> DataFrame:
    """Jobs running for more than ``hours`` become failed, completed now."""
    stale = (F.col("status") == "running") & (F.col("started_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))
    return jobs.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error": F.when(stale, "stale: exceeded run time").otherwise(F.col("error")), "completed_at": F.when(stale, as_of).otherwise(F.col("completed_at"))})


def keyset_page(rows: DataFrame, limit: int, cursor: int | None = None, ident: str = "id") -> DataFrame:
    """One page by descending id below ``cursor``, with next_cursor on its rows (null on the last page)."""
    page = (rows if cursor is None else rows.filter(F.col(ident) < cursor)).orderBy(F.desc(ident)).limit(limit + 1)
    n = F.row_number().over(Window.orderBy(F.desc(ident)))
    more = F.count("*").over(Window.partitionBy()) > limit
    return page.select("*", n.alias("_n"), more.alias("_more")).filter(F.col("_n") <= limit).withColumn("next_cursor", F.when(F.col("_more"), F.min(ident).over(Window.partitionBy()))).drop("_n", "_more")


def recent_turns(turns: DataFrame, per_session: int = 6, sessions: int | None = None) -> DataFrame:
    """The last turns of each session; with ``sessions`` only those of the sessions touched last (by turn, then id)."""
    if sessions is not None:
        touched = turns.groupBy("session_id").agg(F.max("turn").alias("_last")).orderBy(F.desc("_last"), F.desc("session_id")).limit(sessions)
        turns = turns.join(touched.select("session_id"), "session_id", "left_semi")
    turn = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return turns.withColumn("age", F.row_number().over(turn)).filter(F.col("age") <= per_session)


def last_subject(turns: DataFrame, window: int = 6) -> DataFrame:
    """Adds the latest non-empty subject among the ``window`` turns before."""
    frame = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-window, -1)
    return turns.withColumn("last_subject", F.last(F.when(F.col("subject") != "", F.col("subject")), ignorenulls=True).over(frame))


def memory_occupancy(turns: DataFrame, per_session: int = 6, sessions: int = 500) -> DataFrame:
    """One row: sessions and turns that a memory of that size retains."""
    return recent_turns(turns, per_session, sessions).agg(F.count_distinct("session_id").alias("sessions"), F.count("*").alias("turns_total"))


def distribution(events: DataFrame, column: str) -> DataFrame:
    """(column, n): how many events have each value."""
    return events.groupBy(column).agg(F.count("*").alias("n"))


def counter_totals(increments: DataFrame, key: Column, by: Column) -> DataFrame:
    """(metric, value): the increments of each key summed."""
    return increments.groupBy(key.alias("metric")).agg(F.sum(by).alias("value"))


def counters_by_prefix(counters: DataFrame, prefix: str) -> DataFrame:
    return counters.filter(F.col("metric").startswith(prefix)).orderBy(F.desc("value"), "metric")


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def job_status_summary(jobs: DataFrame, as_of: Column) -> DataFrame:
    """(status, n, in_flight, seconds): jobs by status, whether they are still under way, and how long they have run; not started counts 0."""
    ran = F.unix_timestamp(F.coalesce("completed_at", as_of).cast("timestamp")) - F.unix_timestamp(F.col("started_at").cast("timestamp"))
    return jobs.groupBy("status").agg(F.count("*").alias("n"), F.max(F.col("status").isin("queued", "running")).alias("in_flight"), F.coalesce(F.sum(ran), F.lit(0)).alias("seconds"))


def retention_sweep(tables: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(swept, removed): for each name the rows of its first table that its second lacks in number; -1 where counting fails."""
    spark = next(iter(tables.values()))[0].sparkSession

    def removed(before: DataFrame, after: DataFrame) -> int:
        try:
            return before.count() - after.count()
        except PySparkException:  # one table's failure doesn't stop the sweep of the others
            log.exception("a table could not be counted")
            return -1

    return spark.createDataFrame([(name, removed(*both)) for name, both in tables.items()], "swept string, removed long")


def ingest_by_ext(files: DataFrame, name: str) -> DataFrame:
    """(ext, n): files by the extension of their name, lower-cased; none is the empty one."""
    return files.groupBy(F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)(?:[?#].*)?$", 1).alias("ext")).agg(F.count("*").alias("n"))


EVENT_WIDTHS = {"intent": 64, "route": 32, "domain": 64, "error_reason": 255}


def event_rows(events: DataFrame) -> DataFrame:
    """Events as they are stored: the query cut to a preview, and the named texts to their columns' widths."""
    cut = {c: F.substring(c, 1, n) for c, n in EVENT_WIDTHS.items() if c in events.columns}
    return events.withColumns(cut | {"query_preview": preview(F.col("query"))}).drop("query")


def append_query_events(events: DataFrame, path: str) -> None:
    """Adds events to the table at ``path``, by the day on which they were created, so that what is older than a retention goes by folders."""
    event_rows(events).withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
