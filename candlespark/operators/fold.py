"""Placing bars on sessions, rejecting bad ones, and folding bars into candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.bars import epoch_micros, invalid_reason, positive
from candlespark.functions.calendar import bucket_open, local_day, seconds_between
from candlespark.schemas import STORED, TIMEFRAMES, ZONE, parse_timeframe


def on_sessions(bars: DataFrame, sessions: DataFrame, zone: str = ZONE) -> DataFrame:
    """``bars`` with dy (exchange-local day) and its session's open_ts and close_ts, null off the calendar.

    The day is an equi key, so the small calendar side is a hash join; it has a row per day, at most some tens of
    thousands for centuries of trading.
    """
    return bars.withColumn("dy", local_day(F.col("ts"), zone)).join(F.broadcast(sessions), "dy", "left")


def in_session() -> Column:
    """True inside the half-open session."""
    return (F.col("ts") >= F.col("open_ts")) & (F.col("ts") < F.col("close_ts"))


def place_of(ts: Column, ordinal: Column | None = None) -> Column:
    """One number that orders rows by (ts, ordinal) exactly, whatever the ordinals: microseconds times 2**64 plus the
    ordinal. A decimal is a fixed-width aggregation buffer, so the folds stay hash aggregations; a struct wouldn't."""
    micros = epoch_micros(ts)
    if ordinal is None:
        return micros
    wide = lambda c: c.cast("decimal(20,0)")
    return wide(micros) * F.lit(str(1 << 64)).cast("decimal(20,0)") + wide(F.coalesce(ordinal, F.lit(0)))


def ohlcv(order: Column) -> list[Column]:
    """The fold: first open, highest high, lowest low, last close, last non-null adj_close, summed volume.
    ``order`` is a scalar, so the fold stays a hash aggregation with partial sums."""
    return [
        F.min_by("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", order).alias("close"),
        F.max_by("adj_close", F.when(F.col("adj_close").isNotNull(), order)).alias("adj_close"),
        F.sum("volume").alias("volume"),
    ]


def tagged(bars: DataFrame, sessions: DataFrame, timeframe: str, zone: str = ZONE) -> DataFrame:
    """Raw bars with bucket and reject_reason, in one pass; a bar is good where the reason is null.

    Daily bars take any instant of a session day; intraday bars must lie inside the session. A non-positive
    adj_close is read as null before the validity rules.
    """
    timeframe = parse_timeframe(timeframe, stored=True)
    rows = on_sessions(bars.withColumn("adj_close", positive(F.col("adj_close"))), sessions, zone)
    off = F.when(F.col("open_ts").isNull(), F.lit("not a trading day"))
    if timeframe != "1d":
        off = off.when(F.col("ts") < F.col("open_ts"), F.lit("before the session opens")).when(F.col("ts") >= F.col("close_ts"), F.lit("after the session closes"))
    reason = F.when(F.col("ts").isNull(), F.lit("missing timestamp")).otherwise(F.coalesce(off, invalid_reason()))
    return rows.withColumn("reject_reason", reason).withColumn("bucket", F.when(reason.isNull(), bucket_open(timeframe, F.col("ts"), F.col("open_ts"))))


def normalize(bars: DataFrame, sessions: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), zone: str = ZONE) -> tuple[DataFrame, DataFrame]:
    """Raw bars (keys, ts, ordinal, prices, adj_close, volume) to candles and rejected bars.

    Bars of one bucket fold in order of (ts, ordinal), the input's stable order.
    """
    rows = tagged(bars, sessions, timeframe, zone)
    good = rows.where("reject_reason IS NULL").withColumn("_order", place_of(F.col("ts"), F.col("ordinal")))
    candles = good.groupBy(*keys, F.col("bucket").alias("ts")).agg(*ohlcv(F.col("_order")))
    return candles, rows.where("reject_reason IS NOT NULL").drop("bucket", "open_ts", "close_ts")


def tagged_ticks(ticks: DataFrame, sessions: DataFrame, timeframe: str, zone: str = ZONE) -> DataFrame:
    """Ticks with bucket and reject_reason; a tick is a bar of one price and follows a bar's rules."""
    rows = on_sessions(ticks, sessions, zone)
    reason = F.when(F.col("ts").isNull(), F.lit("missing timestamp")).when(F.col("open_ts").isNull(), F.lit("not a trading day"))
    if timeframe != "1d":
        reason = reason.when(~in_session(), F.lit("outside the session"))
    reason = reason.when(F.col("price").isNull() | F.isnan("price") | (F.col("price") <= 0), F.lit("price not positive")).when(F.col("volume") < 0, F.lit("negative volume"))
    return rows.withColumn("reject_reason", reason).withColumn("bucket", F.when(reason.isNull(), bucket_open(parse_timeframe(timeframe), F.col("ts"), F.col("open_ts"))))


def fold_ticks(ticks: DataFrame, sessions: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), zone: str = ZONE) -> DataFrame:
    """Good ticks (keys, ts, price, volume, and ordinal where there is one) to candles with a tick count; what
    ``tagged_ticks`` gives a reason for is left out, so every candle is a valid one."""
    rows = tagged_ticks(ticks, sessions, timeframe, zone).where("reject_reason IS NULL")
    rows = rows.withColumn("_order", place_of(F.col("ts"), F.col("ordinal") if "ordinal" in ticks.columns else None))
    return rows.groupBy(*keys, F.col("bucket").alias("ts")).agg(
        F.min_by("price", "_order").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "_order").alias("close"),
        F.sum("volume").alias("volume"), F.count("*").alias("ticks"),
    )


def strict_reason(base: DataFrame, sessions: DataFrame, keys: Sequence[str] = ("symbol",), zone: str = ZONE) -> DataFrame:
    """Base candles on their sessions with ``problem``: what makes a strict fold refuse them, or null. Where the input
    has an ``ordinal``, its order must be that of time; repeated times are found by the fold itself."""
    previous = F.lag("ts").over(Window.partitionBy(*keys).orderBy("ordinal")) if "ordinal" in base.columns else None
    rows = on_sessions(base, sessions, zone)
    problem = F.coalesce(
        F.when(F.col("open_ts").isNull() | ~in_session(), F.lit("outside its session")),
        F.when(bucket_open("5m", F.col("ts"), F.col("open_ts")) != F.col("ts"), F.lit("off the 5m grid")),
        invalid_reason(),
    )
    if previous is not None:
        problem = F.coalesce(F.when(previous >= F.col("ts"), F.lit("out of time order")), problem)
    return rows.withColumn("problem", problem)


def resample(base: DataFrame, sessions: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), strict: bool = True, zone: str = ZONE, more: Sequence[Column] = ()) -> DataFrame:
    """5m candles to a wider intraday timeframe, anchored at session opens; ts is the bucket's opening. ``more`` are
    further aggregates over a bucket's base candles.

    Strict: a base candle that is invalid, off the grid, outside its session, out of order (where the input has an
    ``ordinal``) or repeated fails the query; otherwise such candles, and buckets with repeated ones, are left out.
    Repeats are found without a window: a bucket's base candles have a bit each, by their place in it. 5m gives the
    input back; 1d is refused, as it comes from its own source.
    """
    timeframe = parse_timeframe(timeframe)
    if timeframe == "1d":
        raise ValueError("1d candles are stored, not folded from 5m")
    rows = strict_reason(base, sessions, keys, zone)
    failure = lambda why: F.raise_error(F.concat(F.lit("a base candle can't be folded: "), why)).cast("timestamp_ntz")
    if strict:
        rows = rows.withColumn("ts", F.when(F.col("problem").isNull(), F.col("ts")).otherwise(failure(F.col("problem"))))
    else:
        rows = rows.where("problem IS NULL")
    rows = rows.withColumn("_b", bucket_open(timeframe, F.col("ts"), F.col("open_ts")))
    bit = F.floor(seconds_between(F.col("_b"), F.col("ts")) / F.lit(300)).cast("int")
    repeats = F.count("*") > F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    folded = rows.groupBy(*keys, "_b").agg(*ohlcv(F.col("ts")), *more, repeats.alias("_twice"))
    if not strict:
        return folded.where("NOT _twice").select(*keys, F.col("_b").alias("ts"), *[c for c in folded.columns if c not in (*keys, "_b", "_twice")])
    at = F.when(F.col("_twice"), failure(F.lit("repeated time"))).otherwise(F.col("_b"))
    return folded.select(*keys, at.alias("ts"), *[c for c in folded.columns if c not in (*keys, "_b", "_twice")])


def with_bars(folded: DataFrame, base: DataFrame, sessions: DataFrame, timeframe: str, keys: Sequence[str] = ("symbol",), zone: str = ZONE) -> DataFrame:
    """Every folded candle with the base candles of [ts, ts + width) in bar_*: an equality join on the bucket that a base
    candle lies in, which a range join over the same interval would do by comparing all of a symbol's."""
    bars = on_sessions(base, sessions, zone).where(in_session()).withColumn("_b", bucket_open(timeframe, F.col("ts"), F.col("open_ts")))
    bars = bars.select(*keys, F.col("_b").alias("ts"), *[F.col(c).alias(f"bar_{c}") for c in ("ts", "open", "high", "low", "close", "volume")])
    return folded.join(bars, [*keys, "ts"])


def base_of(timeframe: str) -> str:
    """The stored timeframe that a timeframe is read from."""
    return TIMEFRAMES[parse_timeframe(timeframe)][1]


def check_stored(timeframe: str) -> str:
    """``timeframe`` where it can be stored, else ValueError."""
    if timeframe not in STORED:
        raise ValueError(f"{timeframe} isn't a stored timeframe, it is made on reading")
    return timeframe
