"""The audit of ingest runs: an append-only log of events, and reads over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VALUES = {"status": "string", "http_status": "int", "bars": "int", "rejected": "int", "error": "string", "started_at": "timestamp_ntz", "finished_at": "timestamp_ntz", "duration_ms": "long"}
LARGEST = (1 << 31) - 1


def opened(chunks: DataFrame, at, known: DataFrame | None = None) -> DataFrame:
    """Events that open a run per chunk (symbol_id, timeframe, range_start, range_end), numbered on from ``known``."""
    top = 0 if known is None else known.agg(F.max("id")).first()[0] or 0
    place = F.row_number().over(Window.orderBy("symbol_id", "timeframe", "range_start"))  # chunks: symbols times windows of one job
    rows = chunks.select((place + F.lit(top)).cast("long").alias("id"), F.lit(0).alias("seq"), "symbol_id", "timeframe", "range_start", "range_end")
    given = {"status": F.lit("running"), "started_at": F.lit(at)}
    return rows.select("*", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in VALUES.items()])


def closed(open_events: DataFrame, results: DataFrame, at) -> DataFrame:
    """Events that close runs. ``results`` has symbol_id, timeframe, range_start and any of bars, rejected, error,
    http_status; an error makes a run failed, and no bars make it empty. Counts are held within 32 bits."""
    keys = ["symbol_id", "timeframe", "range_start"]
    rows = open_events.select("id", *keys, "range_end", "started_at").join(results.select(*keys, *[c for c in ("bars", "rejected", "error", "http_status") if c in results.columns]), keys)
    for c, t in (("bars", "long"), ("rejected", "long"), ("error", "string"), ("http_status", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    count = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)), F.lit(LARGEST)).cast("int")
    status = F.when(F.col("error").isNotNull(), "failed").when(count("bars") > 0, "ok").otherwise("empty")
    end = F.lit(at).cast("timestamp_ntz")
    took = end - F.col("started_at")
    part = lambda unit: F.extract(F.lit(unit), took)
    ms = ((part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")) * 1000).cast("long")
    given = {"status": status, "http_status": F.col("http_status"), "bars": count("bars"), "rejected": count("rejected"), "error": F.col("error"), "started_at": F.col("started_at"), "finished_at": end, "duration_ms": F.when(ms >= 0, F.least(ms, F.lit(LARGEST)))}
    return rows.select("id", F.lit(1).alias("seq"), *keys, "range_end", *[given[c].cast(t).alias(c) for c, t in VALUES.items()])


def run_states(events: DataFrame) -> DataFrame:
    """Current state per run of an append-only log of (id, seq, ...)."""
    values = [c for c in events.columns if c != "id"]
    return events.groupBy("id").agg(F.max_by(F.struct(*values), "seq").alias("s")).select("id", "s.*")


def history(runs: DataFrame, symbol_id: int, timeframe: str, limit: int) -> DataFrame:
    """A series' newest runs."""
    return runs.where((F.col("symbol_id") == symbol_id) & (F.col("timeframe") == timeframe)).orderBy(F.desc("started_at"), "id").limit(limit)


def recent_failures(runs: DataFrame, since, limit: int) -> DataFrame:
    """Newest failed runs that started at ``since`` or later."""
    return runs.where((F.col("status") == "failed") & (F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))).orderBy(F.desc("started_at"), "id").limit(limit)


def usage_between(usage: DataFrame, first, last) -> DataFrame:
    """Daily request counters of an inclusive range of days, in order."""
    return usage.where(F.col("day").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))).orderBy("day")


def usage_total(usage: DataFrame, first, last, quota: int | None = None) -> DataFrame:
    """One row: requests of an inclusive range of days (0 without any), and their percentage of ``quota``."""
    total = F.coalesce(F.sum("requests"), F.lit(0)).cast("long")
    share = [] if quota is None else [(F.when(F.lit(quota) > 0, total * 100.0 / F.lit(quota))).alias("quota_percent")]
    return usage_between(usage, first, last).agg(total.alias("requests"), *share)
