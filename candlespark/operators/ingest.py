"""Planning and running of ingests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.functions.calendar import day_bounds
from candlespark.functions.tickers import check_intraday_range, intraday_range, reachable
from candlespark.operators import gaps
from candlespark.operators.fold import check_stored, normalize
from candlespark.schemas import CHUNK_DAYS, SYNC_RANGE, SYNC_SESSIONS, ZONE


def chunk_windows(spark: SparkSession, start, end, days: int) -> DataFrame:
    """Date windows of ``days`` that tile a range, the last one clipped."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    starts = F.when(a <= b, F.sequence(a, b, F.make_dt_interval(F.lit(days)))).otherwise(F.array().cast("array<date>"))
    rows = spark.range(1).select(F.explode(starts).alias("w_start"))
    return rows.select("w_start", F.least(F.date_add("w_start", days - 1), b).alias("w_end"))


def completed(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Windows (symbol_id, timeframe, w_start, w_end) that one finished run covers: an equi join on the series with
    the containment as a residual."""
    done = runs.where(F.col("status").isin("ok", "empty")).select("symbol_id", "timeframe", "range_start", "range_end")
    w, r = windows.alias("w"), done.alias("r")
    inside = (F.col("r.range_start") <= F.col("w.w_start")) & (F.col("r.range_end") >= F.col("w.w_end"))
    return w.join(r, (F.col("w.symbol_id") == F.col("r.symbol_id")) & (F.col("w.timeframe") == F.col("r.timeframe")) & inside, "left_semi")


def backfill_plan(symbols: DataFrame, windows: DataFrame, clean: DataFrame, runs: DataFrame, timeframe: str, today, has_token: bool = True, force: bool = False) -> DataFrame:
    """Every symbol and window with its action: unreachable, skip or fetch.

    A window is skipped where its coverage is clean (``clean``: symbol_id, w_start), or where it ended before today
    and a finished run covers it.
    """
    # every symbol with every window is what is asked for; windows are a range's chunks, some tens at most
    grid = symbols.select("symbol_id", "ticker").crossJoin(F.broadcast(windows)).withColumn("timeframe", F.lit(timeframe))
    grid = grid.join(clean.select("symbol_id", "w_start").distinct().withColumn("_clean", F.lit(True)), ["symbol_id", "w_start"], "left")
    done = completed(grid.select("symbol_id", "timeframe", "w_start", "w_end"), runs).select("symbol_id", "w_start").withColumn("_done", F.lit(True))
    grid = grid.join(done, ["symbol_id", "w_start"], "left")
    skip = F.col("_clean").isNotNull() | ((F.col("w_end") < F.lit(str(today)).cast("date")) & F.col("_done").isNotNull())
    action = F.when(~reachable(F.col("ticker"), has_token), "unreachable").when(F.lit(not force) & skip, "skip").otherwise("fetch")
    return grid.select("symbol_id", "ticker", *windows.columns, action.alias("action"))


def backfill_windows(spark: SparkSession, timeframe: str, start, end, today, days: int = CHUNK_DAYS, token: str = "", zone: str = ZONE) -> DataFrame:
    """The requests that fill a range for one symbol: w_start, w_end, range, keep_from, keep_to.

    5m takes exactly one request by a range token (the smallest that reaches back to the start, or the one given), whose
    answer is trimmed to the range; 1d takes chunks of ``days``, or one request where a token is given.
    """
    check_stored(timeframe)
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    if str(end) < str(start):
        raise ValueError(f"the range starts on {start}, after its end {end}")
    if timeframe == "5m" and token:
        check_intraday_range(token)
    if timeframe != "5m" and not token:
        null = F.lit(None).cast("timestamp_ntz")
        return chunk_windows(spark, start, end, days if days >= 1 else CHUNK_DAYS).select("*", F.lit("").alias("range"), null.alias("keep_from"), null.alias("keep_to"))
    reach = F.datediff(F.lit(str(today)).cast("date"), a) + 1
    first, last = day_bounds(a, b, zone)
    return spark.range(1).select(a.alias("w_start"), b.alias("w_end"), (F.lit(token) if token else intraday_range(reach)).alias("range"), first.alias("keep_from"), last.alias("keep_to"))


def plan_counts(plan: DataFrame, dry_run: bool = True, results: DataFrame | None = None) -> DataFrame:
    """One row over a plan: symbols, chunks (of reachable symbols), requests, skipped, unreachable (symbols); after a run
    also bars, rejected, empty and failed chunks of ``results``."""
    of = lambda a: F.col("action") == a
    counts = plan.agg(
        F.countDistinct("symbol_id").alias("symbols"), F.count_if(~of("unreachable")).alias("chunks"), F.count_if(of("fetch")).alias("requests"),
        F.count_if(of("skip")).alias("skipped"), F.countDistinct(F.when(of("unreachable"), F.col("symbol_id"))).alias("unreachable"), F.lit(dry_run).alias("dry_run"),
    )
    return counts if results is None else counts.crossJoin(tally(results).drop("chunks"))  # one row each


def first_of(rows: DataFrame, group: str, shown: int) -> DataFrame:
    """Per group its count and its first ``shown`` tickers, without holding more than those."""
    w = Window.partitionBy(group).orderBy("ticker")
    top = rows.select(group, "ticker").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shown)
    lists = top.groupBy(group).agg(F.array_sort(F.collect_list("ticker")).alias("first"))
    return rows.groupBy(group).agg(F.countDistinct("ticker").alias("tickers"), F.count("*").alias("chunks")).join(lists, group)


def sync_plan(symbols: DataFrame, sessions: DataFrame, timeframe: str, today, count: int = SYNC_SESSIONS, has_token: bool = True, zone: str = ZONE) -> DataFrame:
    """A tail refresh: one request per symbol (symbol_id, ticker) for the newest ``count`` sessions up to ``today``, with
    its action (unreachable or fetch), range token and trim bounds (5m only). ``sessions`` is the calendar."""
    check_stored(timeframe)
    last = sessions.where(F.col("dy") <= F.lit(str(today)).cast("date")).select("dy").orderBy(F.desc("dy")).limit(max(count, 1))
    span = last.agg(F.min("dy").alias("w_start"), F.max("dy").alias("w_end"))
    first, end = day_bounds(F.col("w_start"), F.col("w_end"), zone)
    by_range = timeframe == "5m"
    null = F.lit(None).cast("timestamp_ntz")
    span = span.select("w_start", "w_end", F.lit(SYNC_RANGE if by_range else "").alias("range"), (first if by_range else null).alias("keep_from"), (end if by_range else null).alias("keep_to"))
    action = F.when(~reachable(F.col("ticker"), has_token), "unreachable").otherwise("fetch")
    return symbols.select("symbol_id", "ticker", action.alias("action")).crossJoin(F.broadcast(span))  # one row


def run_chunks(plan: DataFrame, bars: DataFrame, errors: DataFrame, sessions: DataFrame, timeframe: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers to a plan's fetched requests, to candles, rejected bars, and a result per chunk.

    ``bars`` (symbol_id, w_start, ts, ordinal, prices, adj_close, volume) and ``errors`` (symbol_id, w_start, error,
    http_status) are what the provider gave. A chunk is failed where it has an error, ok where candles are left after
    the trim to [keep_from, keep_to), else empty. A failed chunk stores nothing.
    """
    keys = ["symbol_id", "w_start"]
    asked = plan.where("action = 'fetch'").select(*keys, "ticker", "w_end", "keep_from", "keep_to")
    good = bars.join(errors.select(*keys), keys, "left_anti").join(asked.select(*keys), keys, "left_semi")
    candles, rejected = normalize(good, sessions, timeframe, keys)
    bounds = asked.select(*keys, "keep_from", "keep_to")
    inside = (F.col("keep_from").isNull() | (F.col("ts") >= F.col("keep_from"))) & (F.col("keep_to").isNull() | (F.col("ts") < F.col("keep_to")))
    kept = candles.join(bounds, keys).where(inside).drop("keep_from", "keep_to")
    counted = kept.groupBy(*keys).agg(F.count("*").alias("bars"))
    bad = rejected.groupBy(*keys).agg(F.count("*").alias("rejected"))
    rows = asked.join(counted, keys, "left").join(bad, keys, "left").join(errors.select(*keys, "error", "http_status"), keys, "left")
    zero = F.lit(0).cast("long")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.coalesce("bars", zero) > 0, "ok").otherwise("empty")
    results = rows.select(
        "symbol_id", "ticker", F.lit(timeframe).alias("timeframe"), F.col("w_start").alias("range_start"), F.col("w_end").alias("range_end"), status.alias("status"),
        F.coalesce("bars", zero).alias("bars"), F.coalesce("rejected", zero).alias("rejected"), "error", "http_status",
    )
    return kept, rejected, results


def tally(results: DataFrame) -> DataFrame:
    """One row over chunk results (status, bars, rejected)."""
    return results.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("bars"), F.lit(0)).alias("bars"), F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.count_if(F.col("status") == "empty").alias("empty"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def rejection_sample(rejected: DataFrame, key: str = "symbol", shown: int = 3) -> DataFrame:
    """Per series the number of rejected bars and, in the order of (ts, ordinal), the first ``shown`` of them as
    ``time: reason``. Rows beyond those are dropped before the shuffle (a limit on the rank)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("ts", "ordinal"))
    first = rejected.select(key, "ts", "ordinal", "reject_reason", place.alias("_n")).where(F.col("_n") <= shown)
    text = F.concat(F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("no time")), F.lit(": "), F.col("reject_reason"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", text.alias("why")))), lambda x: x["why"]).alias("reasons"))
    return rejected.groupBy(key).agg(F.count("*").alias("rejected")).join(lists, key)


def trim(bars: DataFrame, keep_from=None, keep_to=None) -> DataFrame:
    """Bars inside [keep_from, keep_to), each bound optional."""
    rows = bars if keep_from is None else bars.where(F.col("ts") >= F.lit(keep_from).cast("timestamp_ntz"))
    return rows if keep_to is None else rows.where(F.col("ts") < F.lit(keep_to).cast("timestamp_ntz"))


def ingest(bars: DataFrame, sessions: DataFrame, timeframe: str, keep_from=None, keep_to=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw bars to candles, rejected bars, and a result per symbol: status, bars, rejected, first three reasons."""
    candles, rejected = normalize(bars, sessions, timeframe)
    kept = trim(candles, keep_from, keep_to)
    good = kept.groupBy("symbol").agg(F.count("*").alias("bars"))
    results = bars.select("symbol").distinct().join(good, "symbol", "left").join(rejection_sample(rejected), "symbol", "left")
    zero = F.lit(0).cast("long")
    results = results.select(
        "symbol", F.when(F.coalesce("bars", zero) > 0, "ok").otherwise("empty").alias("status"),
        F.coalesce("bars", zero).alias("bars"), F.coalesce("rejected", zero).alias("rejected"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"),
    )
    return kept, rejected, results


def covered(bars: DataFrame, sessions: DataFrame, timeframe: str, symbols: DataFrame) -> DataFrame:
    """Symbols whose coverage of the sessions is clean."""
    return gaps.report(bars, sessions, timeframe, symbols).where("clean").select("symbol")


def usage_window(today: dt.date) -> tuple[dt.date, dt.date]:
    """First and last day of a date's month."""
    first = today.replace(day=1)
    return first, (first + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1)
