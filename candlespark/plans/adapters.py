"""Views of the driver's tables as market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.functions.calendar import sessions

#: The span of the ticks, and the one holiday and one short day inside it.
FIRST, LAST = "2024-01-01", "2024-01-31"
HOLIDAYS = [("2024-01-01", "New Year", None, None), ("2024-01-25", "Short day", "13:00", None)]
TODAY = "2024-01-30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holidays(spark: SparkSession) -> DataFrame:
    """The holiday table of the ticks' span."""
    rows = spark.createDataFrame(HOLIDAYS, "day string, name string, open string, close string")
    return rows.withColumn("day", F.col("day").cast("date"))


def january(spark: SparkSession) -> DataFrame:
    """Sessions of the ticks' span."""
    return sessions(spark, FIRST, LAST, holidays(spark))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: symbol, ts, price, volume, ordinal."""
    volume = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), volume.alias("volume"), F.col("event_id").alias("ordinal"))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw provider bars, some of them impossible: every 97th has a zero low, every 89th a negative volume,
    every 11th no adjusted close, every 13th a zero one."""
    t = ticks(spark, sf_dir)
    low = F.when(F.col("ordinal") % 97 == 0, F.lit(0.0)).otherwise(F.col("price"))
    adj = F.when(F.col("ordinal") % 11 == 0, F.lit(None)).when(F.col("ordinal") % 13 == 0, F.lit(0.0)).otherwise(F.col("price"))
    volume = F.when(F.col("ordinal") % 89 == 0, F.lit(-1).cast("long")).otherwise(F.col("volume"))
    return t.select("symbol", "ts", F.col("price").alias("open"), F.col("price").alias("high"), low.alias("low"), F.col("price").alias("close"), adj.alias("adj_close"), volume.alias("volume"), "ordinal")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as raw daily bars."""
    p = F.col("o_totalprice")
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), (F.col("o_orderdate") + F.expr("interval 12 hours")).alias("ts"), p.alias("open"), p.alias("high"), p.alias("low"), p.alias("close"), p.alias("adj_close"), F.lit(1).cast("long").alias("volume"), F.col("o_orderkey").alias("ordinal"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as symbols: tickers of all shapes, names with holes."""
    k = F.col("p_partkey")
    letter = lambda d: F.char(F.lit(65) + F.pmod(F.floor(k / F.lit(d)), F.lit(26)).cast("int"))
    root = F.concat(letter(1), letter(26), letter(676), letter(7))
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("3", "4", "11", "34", "5", "99")]), (k % 6 + 1).cast("int"))
    ticker = F.when(k % 50 == 0, F.concat(F.lit("^"), root)).when(k % 51 == 0, F.concat(F.lit("WINZ"), F.lpad((k % 100).cast("string"), 2, "0"))).when(k % 52 == 0, F.concat(root, F.lit("-USD"))).otherwise(F.concat(root, suffix))
    rows = read(spark, sf_dir, "part").select(ticker.alias("ticker"), F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("p_name")).alias("long_name"), F.when(k % 3 == 0, ticker).when(k % 4 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("short_name"), (k % 2 == 0).alias("tracked"), (k % 7 != 0).alias("active"), k.alias("id"))
    return rows.groupBy("ticker").agg(F.min("id").alias("id"), F.min_by("long_name", "id").alias("long_name"), F.min_by("short_name", "id").alias("short_name"), F.bool_or("tracked").alias("tracked"), F.bool_or("active").alias("active"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as ingest runs."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "empty").otherwise("failed")
    start = F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("symbol_id"), F.lit("1d").alias("timeframe"), start.alias("range_start"), F.date_add(start, (F.col("o_orderkey") % 120).cast("int")).alias("range_end"), status.alias("status"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderkey") % 90).cast("int").alias("bars"), (F.col("o_orderkey") % 4).cast("int").alias("rejected"))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as monthly bars of futures: every root (priority) has a contract a half-year, an order trades this half-year's or the
    next one's; what is in front changes with the volume."""
    at = F.col("o_orderdate")
    half = F.year(at) * 2 + F.when(F.month(at) > 6, 1).otherwise(0) + F.when(F.col("o_custkey") % 5 < F.month(at) % 6, 1).otherwise(0)
    expiry = F.last_day(F.make_date(F.floor(half / 2).cast("int"), F.when(half % 2 == 0, 6).otherwise(12), F.lit(1)))
    rows = read(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 3, 30).alias("root"), expiry.alias("expiry"), F.trunc(at.cast("date"), "month").alias("dy"), "o_orderkey", "o_totalprice", "o_custkey")
    key = F.col("o_orderkey")
    rows = rows.groupBy("root", "expiry", "dy").agg(
        F.min_by("o_totalprice", key).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", key).alias("close"), F.sum(F.col("o_custkey") % 50).alias("volume")
    )
    return rows.select("root", F.concat_ws("-", "root", F.date_format("expiry", "yyyyMM")).alias("contract"), "expiry", F.col("dy").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as monthly bars of an average price in cents: symbol=o_orderpriority, the close without the month's last ten days."""
    day = F.dayofmonth("o_orderdate")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz").alias("ts"), F.bround(F.col("o_totalprice") * 100).cast("long").alias("_c"), (day <= 20).alias("_early"))
    mean = lambda c: F.call_function("div", F.sum(c), F.count(c)) / 100
    rows = rows.groupBy("symbol", "ts").agg(mean(F.col("_c")).alias("open"), mean(F.when(F.col("_early"), F.col("_c"))).alias("close"))
    return rows.withColumn("close", F.coalesce("close", "open"))
