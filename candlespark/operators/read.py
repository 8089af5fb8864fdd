"""Reads over stored candles: ranges, newest and oldest, folded pages, response bodies, previews."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.bars import epoch_seconds
from candlespark.functions.tickers import etag
from candlespark.operators.fold import base_of, resample
from candlespark.schemas import KEEP_CLOSED, KEEP_OPEN, KEEP_SYMBOLS, PAGE_DEFAULT, PAGE_MAX, READ_CAP, TIMEFRAMES, ZONE

PREVIEW = 20
PAGE_VALUES = ("open", "high", "low", "close", "adj_close", "volume")


def instant(at: str | dt.datetime) -> dt.datetime:
    """A UTC instant from an ISO text or a datetime; offsets are applied, a text without one is UTC."""
    found = dt.datetime.fromisoformat(at) if isinstance(at, str) else at
    return found if found.tzinfo is None else found.astimezone(dt.UTC).replace(tzinfo=None)


def between(df: DataFrame, start, end) -> DataFrame:
    """Rows of the half-open window, as predicates that reach the scan. Bounds are columns, days, or what ``instant`` takes: a text
    with an offset is that instant in UTC, whatever the session's zone."""

    def bound(at):
        if isinstance(at, Column):
            return at
        return F.lit((instant(at) if isinstance(at, str | dt.datetime) else at).isoformat()).cast("timestamp_ntz")

    return df.where((F.col("ts") >= bound(start)) & (F.col("ts") < bound(end)))


def list_candles(candles: DataFrame, symbol, start, end, limit: int, newest: bool = False) -> DataFrame:
    """The oldest or newest ``limit`` candles of one symbol's window, in that order."""
    order = F.desc("ts") if newest else F.asc("ts")
    return between(candles.where(F.col("symbol") == symbol), start, end).orderBy(order).limit(limit)


def timestamps(candles: DataFrame, symbol, start, end) -> DataFrame:
    """Only the timestamps of one symbol's window."""
    return between(candles.where(F.col("symbol") == symbol), start, end).select("ts").orderBy("ts")


def earliest_latest(candles: DataFrame, keys=("symbol",)) -> DataFrame:
    """First and last timestamp and close per series; a series without rows has none."""
    return candles.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"), F.min_by("close", "ts").alias("first_close"), F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last_close"), F.count("*").alias("bars")
    )


def clamp_limit(limit: int | None) -> int:
    """Page size within 1..5000, 1000 by default."""
    return PAGE_DEFAULT if not limit or limit < 1 else min(limit, PAGE_MAX)


def base_cap(timeframe: str, limit: int) -> int:
    """Base rows that hold ``limit`` buckets for certain, and one more that tells whether there are older ones."""
    per_bucket = TIMEFRAMES[timeframe][2]
    return min(limit * per_bucket + 1, (1 << 31) - 1)


def page(base: DataFrame, sessions: DataFrame, symbol, timeframe: str, start, end, before=None, limit: int | None = None, zone: str = ZONE) -> DataFrame:
    """Newest ``limit`` candles of a window before an exclusive cursor, ascending, with has_more and cursor on each row.

    The limit is pushed through the fold: the newest base rows are taken first (top-k on the scan), and where that
    cut is full, the oldest bucket may be partial and goes. The fold is the strict one: a stored candle that it can't
    fold fails the page. Stored timeframes are given back as they are.
    """
    limit = clamp_limit(limit)
    cap = base_cap(timeframe, limit)
    until = instant(end) if before is None else min(instant(before), instant(end))
    rows = list_candles(base, symbol, instant(start), until, cap, newest=True)
    rows = rows.withColumn("_rows", F.count("*").over(Window.partitionBy("symbol")))
    if base_of(timeframe) != timeframe:
        rows = resample(rows, sessions, timeframe, zone=zone, more=[F.max("_rows").alias("_rows")])
    newest, oldest = Window.partitionBy("symbol").orderBy(F.desc("ts")), Window.partitionBy("symbol").orderBy("ts")
    rows = rows.withColumn("_new", F.row_number().over(newest)).withColumn("_old", F.row_number().over(oldest))
    full = F.col("_rows") == cap
    rows = rows.withColumn("_buckets", F.count("*").over(Window.partitionBy("symbol")))
    more = full | (F.col("_buckets") > limit)
    kept = rows.where((F.col("_new") <= limit) & ~(full & (F.col("_old") == 1)))
    kept = kept.withColumn("has_more", more).withColumn("cursor", F.when(more, F.min("ts").over(Window.partitionBy("symbol"))))
    names = ["symbol", "ts", *PAGE_VALUES, "has_more", "cursor"]
    return kept.select(*[c for c in names if c in kept.columns]).orderBy("ts")


def without_loaded(page_: DataFrame, loaded: DataFrame, keys=("symbol",)) -> DataFrame:
    """Rows of an older page that the caller doesn't hold yet."""
    return page_.join(loaded.select(*keys, "ts"), [*keys, "ts"], "left_anti")


def load(base: DataFrame, sessions: DataFrame, symbol, timeframe: str, start, end, limit: int = READ_CAP) -> DataFrame:
    """Oldest candles of a window, folded from at most ``limit`` base rows; the last bucket can be partial."""
    rows = list_candles(base, symbol, start, end, limit if limit >= 1 else READ_CAP)
    return rows if base_of(timeframe) == timeframe else resample(rows, sessions, timeframe)


def series_stats(base: DataFrame, keys=("symbol",)) -> DataFrame:
    """Bars, volume, highest high and lowest low per series."""
    return base.groupBy(*keys).agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low"))


def reconcile(base: DataFrame, folded: DataFrame, keys=("symbol",)) -> DataFrame:
    """Volume, high and low of a folded series against its base, with a verdict."""
    a, b = series_stats(base, keys), series_stats(folded, keys)
    both = a.join(b.select(*keys, *[F.col(c).alias(f"folded_{c}") for c in ("bars", "volume", "high", "low")]), list(keys))
    same = (F.col("volume") == F.col("folded_volume")) & (F.col("high") == F.col("folded_high")) & (F.col("low") == F.col("folded_low"))
    return both.withColumn("verdict", F.when(same, "ok").otherwise("MISMATCH"))


def columnar(candles: DataFrame, keys=("symbol",)) -> DataFrame:
    """One row of parallel arrays per series, in time order."""
    row = F.struct(epoch_seconds(F.col("ts")).alias("t"), "open", "high", "low", "close", "volume")
    arrays = candles.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("r"))
    return arrays.select(*keys, *[F.col(f"r.{a}").alias(b) for a, b in (("t", "ts"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))])


def rows_of(body: DataFrame, keys=("symbol",)) -> DataFrame:
    """Parallel arrays back to rows."""
    zipped = body.select(*keys, F.arrays_zip("ts", "o", "h", "l", "c", "v").alias("z"))
    return zipped.select(*keys, F.inline("z")).select(*keys, F.col("ts").alias("epoch"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"))


def head_and_tail(candles: DataFrame, keys=("symbol",), shown: int = PREVIEW) -> DataFrame:
    """First and last ``shown`` candles of every series with their places; all of a short series."""
    w = Window.partitionBy(*keys)
    rows = candles.withColumn("place", F.row_number().over(w.orderBy("ts"))).withColumn("total", F.count("*").over(w))
    return rows.where((F.col("total") <= 2 * shown) | (F.col("place") <= shown) | (F.col("place") > F.col("total") - shown))


def arrays_of_page(page_: DataFrame, symbol: str, timeframe: str, end, now) -> DataFrame:
    """A page (``page``'s rows) as one row: symbol, timeframe, base, count, the parallel arrays, next_cursor (RFC 3339,
    null without more) and cache_control. A page without rows gives empty arrays. A page has at most PAGE_MAX rows."""
    row = F.struct(epoch_seconds(F.col("ts")).alias("t"), "open", "high", "low", "close", "volume")
    one = page_.agg(F.sort_array(F.collect_list(row)).alias("r"), F.max("cursor").alias("cursor"))
    closed = F.lit(instant(end)).cast("timestamp_ntz") <= F.lit(instant(now)).cast("timestamp_ntz")
    return one.select(
        F.lit(symbol).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.lit(base_of(timeframe)).alias("base"), F.size("r").alias("count"),
        *[F.col(f"r.{a}").alias(b) for a, b in (("t", "ts"), ("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))],
        F.date_format("cursor", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("next_cursor"), cache_policy(closed).alias("cache_control"),
    )


def page_body(page_: DataFrame, symbol: str, timeframe: str, end, now) -> DataFrame:
    """One row: body (JSON; next_cursor left out where there is no more), etag and cache_control of a page's response.
    ``end`` is the window's end, or the cursor before it; a window that ended by ``now`` never changes."""
    one = arrays_of_page(page_, symbol, timeframe, end, now)
    return one.select(F.to_json(F.struct(*[c for c in one.columns if c != "cache_control"])).alias("body"), "cache_control").select("body", etag(F.col("body")).alias("etag"), "cache_control")


def cache_policy(closed: Column | None = None) -> Column:
    """How long a response may be kept: for ever where its window is closed, not at all where it is open; without a
    window (a listing of symbols) for five minutes."""
    return F.lit(KEEP_SYMBOLS) if closed is None else F.when(closed, F.lit(KEEP_CLOSED)).otherwise(F.lit(KEEP_OPEN))


def json_bodies(pages: DataFrame, keys=("symbol",), now=None, end=None) -> DataFrame:
    """Response body, ETag and, where ``now`` and the window's ``end`` (a time, or a column of ``pages``) are given,
    whether the window is closed (end <= now) and its cache_control; next_cursor only where there is more."""
    if (now is None) != (end is None):
        raise ValueError("now and end go together")
    body = F.to_json(F.struct(*keys, "ts", "o", "h", "l", "c", "v", *[c for c in ("next_cursor",) if c in pages.columns]))
    out = pages.select(*keys, body.alias("body"), *([] if now is None else [((end if isinstance(end, Column) else F.lit(instant(end))).cast("timestamp_ntz") <= F.lit(instant(now)).cast("timestamp_ntz")).alias("closed")]))
    extra = [] if now is None else ["closed", cache_policy(F.col("closed")).alias("cache_control")]
    return out.select(*keys, "body", etag(F.col("body")).alias("etag"), *extra)
