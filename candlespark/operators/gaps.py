"""Coverage of sessions by stored bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.functions.calendar import bucket_count
from candlespark.operators.fold import check_stored, in_session, on_sessions
from candlespark.schemas import ZONE


def per_session(bars: DataFrame, sessions: DataFrame, timeframe: str, symbols: DataFrame, zone: str = ZONE) -> DataFrame:
    """Every symbol on every session: expected and present bars, and missing, partial or complete."""
    check_stored(timeframe)
    present = on_sessions(bars.select("symbol", "ts"), sessions, zone).where(in_session()).groupBy("symbol", "dy").agg(F.count("*").alias("present"))
    grid = symbols.select("symbol").distinct().crossJoin(F.broadcast(sessions))  # what a gap report lists; one row a trading day
    rows = grid.join(present, ["symbol", "dy"], "left").withColumn("present", F.coalesce("present", F.lit(0).cast("long")))
    rows = rows.withColumn("expected", bucket_count(timeframe, F.col("open_ts"), F.col("close_ts")).cast("long"))
    state = F.when(F.col("present") == 0, "missing").when(F.col("present") < F.col("expected"), "partial").otherwise("complete")
    return rows.select("symbol", "dy", "expected", "present", state.alias("state"))


def unexpected(bars: DataFrame, sessions: DataFrame, zone: str = ZONE) -> DataFrame:
    """Bars outside every session."""
    return on_sessions(bars.select("symbol", "ts"), sessions, zone).where(F.col("open_ts").isNull() | ~in_session()).select("symbol", "ts")


def report(bars: DataFrame, sessions: DataFrame, timeframe: str, symbols: DataFrame, zone: str = ZONE) -> DataFrame:
    """Per symbol: sessions, expected and present bars, missing, partial and unexpected counts, clean, empty."""
    grid = per_session(bars, sessions, timeframe, symbols, zone).groupBy("symbol").agg(
        F.count("*").alias("sessions"), F.sum("expected").alias("expected"), F.sum("present").alias("bars"),
        F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "partial").alias("partial"),
    )
    odd = unexpected(bars, sessions, zone).groupBy("symbol").agg(F.count("*").alias("unexpected"))
    rows = grid.join(odd, "symbol", "left").withColumn("unexpected", F.coalesce("unexpected", F.lit(0).cast("long")))
    rows = rows.withColumn("clean", (F.col("missing") == 0) & (F.col("unexpected") == 0))
    return rows.withColumn("empty", (F.col("bars") == 0) & (F.col("unexpected") == 0))


def lists(bars: DataFrame, sessions: DataFrame, timeframe: str, symbols: DataFrame, shown: int = 10, zone: str = ZONE) -> DataFrame:
    """Per symbol the first missing days, partial days and their counts, as a printed report shows them."""
    rows = per_session(bars, sessions, timeframe, symbols, zone)
    days = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("dy"))))
    out = rows.groupBy("symbol").agg(days("missing").alias("m"), days("partial").alias("p"))
    return out.select("symbol", F.slice("m", 1, shown).alias("missing_days"), F.size("m").alias("missing"), F.slice("p", 1, shown).alias("partial_days"), F.size("p").alias("partial"))


def universe(report_: DataFrame) -> DataFrame:
    """One row over all symbols' reports: symbols, dirty and empty ones."""
    return report_.agg(F.count("*").alias("symbols"), F.count_if(~F.col("clean")).alias("dirty"), F.count_if("empty").alias("empty_symbols"), F.sum("bars").alias("bars"))
