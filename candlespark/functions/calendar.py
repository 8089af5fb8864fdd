"""Exchange calendar as DataFrames and columns. All instants are TIMESTAMP_NTZ in UTC, and no expression reads the
session time zone: zone shifts go through convert_timezone, differences through interval arithmetic."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlespark.schemas import ZONE, width

DayLike = str | dt.date
OPEN, CLOSE = "10:00", "17:00"
#: Calendar days that a search for the next or previous session takes.
SEARCH_DAYS = 30


def local(ts: Column, zone: str = ZONE) -> Column:
    """Wall-clock time at the exchange of a UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def utc(wall: Column, zone: str = ZONE) -> Column:
    """UTC instant of a wall-clock time at the exchange."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """Exchange-local date of a UTC instant."""
    return local(ts, zone).cast("date")


def minutes(clock: Column) -> Column:
    """Minutes since midnight of a strict HH:MM text; other texts raise."""
    good = clock.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    value = F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int")
    return F.when(good, value).when(clock.isNotNull(), F.raise_error(F.concat(F.lit("bad clock "), clock)).cast("int"))


def add_seconds(ts: Column, seconds: Column) -> Column:
    """``ts`` plus a number of seconds."""
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, both TIMESTAMP_NTZ, by interval arithmetic."""
    d = end - start
    part = lambda unit: F.extract(F.lit(unit), d)
    return (part("DAY").cast("long") * 86400 + part("HOUR").cast("long") * 3600 + part("MINUTE").cast("long") * 60 + F.floor(part("SECOND"))).cast("long")


def days(spark: SparkSession, start: DayLike, end: DayLike) -> DataFrame:
    """Every date from ``start`` to ``end``, both included; none if they are in the wrong order."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")
    span = F.when(a <= b, F.sequence(a, b, F.expr("interval 1 day"))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(span).alias("dy"))


def no_holidays(spark: SparkSession) -> DataFrame:
    """An empty holiday table."""
    return spark.createDataFrame([], "day date, name string, open string, close string")


def sessions(spark: SparkSession, start: DayLike, end: DayLike, holidays: DataFrame | None = None, open_at: str = OPEN, close_at: str = CLOSE, zone: str = ZONE) -> DataFrame:
    """Trading sessions by exchange-local day: dy, open_ts, close_ts (UTC).

    A holiday row without hours closes the day; one with ``open`` or ``close`` shortens it. Days beyond the
    holiday table's years count as trading unless they are weekend days.
    """
    holidays = no_holidays(spark) if holidays is None else holidays
    marks = holidays.select(F.col("day").alias("dy"), F.col("open").alias("h_open"), F.col("close").alias("h_close"), F.lit(True).alias("marked"))
    rows = days(spark, start, end).where(F.weekday("dy") < 5).join(F.broadcast(marks), "dy", "left")
    rows = rows.where(F.col("marked").isNull() | F.col("h_open").isNotNull() | F.col("h_close").isNotNull())
    at = lambda mark, usual: utc(add_seconds(F.col("dy").cast("timestamp_ntz"), minutes(F.coalesce(F.col(mark), F.lit(usual))) * 60), zone)
    return rows.select("dy", at("h_open", open_at).alias("open_ts"), at("h_close", close_at).alias("close_ts"))


def trading_days(spark: SparkSession, start: DayLike, end: DayLike, holidays: DataFrame | None = None) -> DataFrame:
    """Trading days between two dates, both included."""
    return sessions(spark, start, end, holidays).select("dy")


def neighbours(sessions_: DataFrame) -> DataFrame:
    """Trading days with the trading day before and after each."""
    w = Window.orderBy("dy")
    return sessions_.select("dy", F.lag("dy").over(w).alias("prev_day"), F.lead("dy").over(w).alias("next_day"))


def buckets_of(timeframe: str, open_ts: Column, close_ts: Column) -> Column:
    """Bucket openings of a session, a short last bucket included; the daily timeframe has one."""
    if timeframe == "1d":
        return F.array(open_ts)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(width(timeframe)))
    return F.sequence(open_ts, close_ts - F.expr("interval 1 second"), step)


def bucket_count(timeframe: str, open_ts: Column, close_ts: Column) -> Column:
    """Number of buckets of a session, rounded up."""
    if timeframe == "1d":
        return F.lit(1)
    w = width(timeframe)
    return F.floor((seconds_between(open_ts, close_ts) + (w - 1)) / F.lit(w)).cast("int")


def bucket_open(timeframe: str, ts: Column, open_ts: Column) -> Column:
    """Opening of the bucket that holds ``ts``, anchored at the session's open."""
    if timeframe == "1d":
        return open_ts
    w = width(timeframe)
    return add_seconds(open_ts, F.floor(seconds_between(open_ts, ts) / F.lit(w)) * w)


def day_bounds(start: Column, end: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """UTC instants of local midnight of ``start`` and of the day after ``end``."""
    return utc(start.cast("timestamp_ntz"), zone), utc(F.date_add(end, 1).cast("timestamp_ntz"), zone)


def refresh_window(spark: SparkSession, today: DayLike, count: int, holidays: DataFrame | None = None) -> DataFrame:
    """First and last day of the ``count`` newest sessions up to ``today``."""
    count = max(count, 1)
    day = dt.date.fromisoformat(str(today))
    rows = trading_days(spark, day - dt.timedelta(days=30 + 3 * count), day, holidays)
    return rows.orderBy(F.desc("dy")).limit(count).agg(F.min("dy").alias("start_day"), F.max("dy").alias("end_day"))


def coverage(holidays: DataFrame) -> DataFrame:
    """One row: smallest and largest year of the holiday table."""
    return holidays.agg(F.min(F.year("day")).alias("first_year"), F.max(F.year("day")).alias("last_year"))


def covered_days(rows: DataFrame, holidays: DataFrame, day: str = "dy") -> DataFrame:
    """``rows`` with ``covered``: whether the holiday table reaches the year of ``day`` (a local date)."""
    year = F.year(day)
    covered = F.coalesce(year.between(F.col("first_year"), F.col("last_year")), F.lit(False))
    return rows.crossJoin(F.broadcast(coverage(holidays))).withColumn("covered", covered).drop("first_year", "last_year")  # one row


def nearest_sessions(spark: SparkSession, rows: DataFrame, sessions_: DataFrame, start: DayLike, end: DayLike, day: str = "dy", strict: bool = True) -> DataFrame:
    """``rows`` with next_day and prev_day: the trading days after and before ``day``, itself a trading day or not,
    within SEARCH_DAYS. Strict: a day of ``start``..``end`` without one fails the query.

    A table with a row a calendar day is made from the sessions by running minima and maxima, and joined by equality.
    """
    a, b = dt.date.fromisoformat(str(start)), dt.date.fromisoformat(str(end))
    span = dt.timedelta(days=SEARCH_DAYS)
    table = days(spark, a - span, b + span).join(F.broadcast(sessions_.select("dy", F.col("dy").alias("at"))), "dy", "left")
    w = Window.orderBy("dy")  # a dimension: one row a calendar day
    after, before = w.rowsBetween(1, SEARCH_DAYS), w.rowsBetween(-SEARCH_DAYS, -1)
    table = table.select(F.col("dy").alias(day), F.min("at").over(after).alias("next_day"), F.max("at").over(before).alias("prev_day"))
    table = table.where(F.col(day).between(F.lit(str(a)).cast("date"), F.lit(str(b)).cast("date")))
    if strict:
        none = lambda c, where: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no session in {SEARCH_DAYS} days {where} "), F.col(day).cast("string"))).cast("date")).alias(c)
        table = table.select(day, none("next_day", "after"), none("prev_day", "before"))
    return rows.join(F.broadcast(table), day, "left")
