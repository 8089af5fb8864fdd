"""Upserts as full outer joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDLE_KEY = ("symbol_id", "timeframe", "ts")
#: Rules of an upserted column: old and new value to the stored one.
RULES = {
    "new": lambda old, new, there: F.when(there, new).otherwise(old),
    "keep": lambda old, new, there: F.coalesce(new, old),
    "or": lambda old, new, there: F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False)),
    "least": lambda old, new, there: F.least(old, new),
    "greatest": lambda old, new, there: F.greatest(old, new),
    "add": lambda old, new, there: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str]) -> DataFrame:
    """``old`` after ``new`` came in; both hold a key once. Columns without a rule take the new row's value; those that
    ``new`` doesn't have stay."""
    values = [c for c in old.columns if c not in key]
    missing = [c for c in values if c not in new.columns]
    new = new.select("*", *[F.lit(None).cast(old.schema[c].dataType).alias(c) for c in missing])
    rules = {c: "keep" for c in missing} | rules
    a = old.select(*key, *[F.col(c).alias(f"_o_{c}") for c in values])
    b = new.select(*key, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_there"))
    rows = a.join(b, list(key), "full")
    there = F.col("_there").isNotNull()
    return rows.select(*key, *[RULES[rules.get(c, "new")](F.col(f"_o_{c}"), F.col(f"_n_{c}"), there).alias(c) for c in values])


def upsert_candles(old: DataFrame, new: DataFrame, key: Sequence[str] = CANDLE_KEY) -> DataFrame:
    """Newer candles win, but a null adj_close doesn't erase a stored one."""
    return upsert(old, new, key, {"adj_close": "keep"})


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names and point value are kept where the new ones are null, tracked latches, first and last seen widen."""
    rules = {"short_name": "keep", "long_name": "keep", "point_value": "keep", "tracked": "or", "first_seen": "least", "last_seen": "greatest"}
    return upsert(old, new, ["ticker"], rules)


def add_usage(old: DataFrame, new: DataFrame) -> DataFrame:
    """Daily request counters, added up."""
    return upsert(old, new, ["day"], {"requests": "add"})


def with_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """New symbols numbered on from the largest id in ``known``."""
    from pyspark.sql import Window

    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    place = F.row_number().over(Window.orderBy("ticker"))
    return rows.drop("id").crossJoin(F.broadcast(top)).withColumn("id", (place + F.col("_top")).cast("long")).drop("_top")


def deactivate(symbols: DataFrame, tickers: DataFrame) -> DataFrame:
    """``symbols`` with the listed ones inactive, and changed where they weren't before."""
    marked = symbols.join(tickers.select("ticker").distinct().withColumn("_hit", F.lit(True)), "ticker", "left")
    changed = F.col("active") & F.col("_hit").isNotNull()
    return marked.withColumn("changed", changed).withColumn("active", F.col("active") & ~changed).drop("_hit")


def constraint_breaks(candles: DataFrame) -> DataFrame:
    """Rows that a candle table's constraints refuse, with the reason; repeated keys are among them."""
    from candlespark.functions.bars import invalid_reason
    from candlespark.schemas import STORED

    reason = F.coalesce(F.when(~F.col("timeframe").isin(*STORED), F.lit("timeframe not stored")), invalid_reason())
    bad = candles.withColumn("reason", reason).where("reason IS NOT NULL").select(*CANDLE_KEY, "reason")
    twice = candles.groupBy(*CANDLE_KEY).count().where("count > 1").select(*CANDLE_KEY, F.lit("repeated key").alias("reason"))
    return bad.unionByName(twice)
