"""Streaming refresh: ticks folded per micro-batch window, late bars upserted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlespark.functions.bars import as_instant
from candlespark.operators import store
from candlespark.operators.fold import normalize, tagged_ticks
from candlespark.operators.upsert import CANDLE_KEY, upsert_candles


def windowed(ticks: DataFrame, sessions: DataFrame, timeframe: str, lateness: str = "5 days") -> DataFrame:
    """A stream of ticks (symbol, ts, price, volume, and ordinal where ticks can share an instant) to session-anchored candles; a bucket is final, and leaves in
    append mode, once the watermark passes it."""
    rows = tagged_ticks(ticks, sessions, timeframe).where("reject_reason IS NULL")
    rows = rows.withColumn("at", as_instant(F.col("bucket"))).withWatermark("at", lateness)
    place = F.struct("ts", "ordinal") if "ordinal" in ticks.columns else F.col("ts")
    return rows.groupBy("symbol", "at").agg(
        F.min_by("price", place).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", place).alias("close"), F.sum("volume").alias("volume"),
    )


def once_per_key(bars: DataFrame, keys=("symbol", "at"), lateness: str = "5 days") -> DataFrame:
    """A stream without repeated bars inside the lateness; ``at`` is the event time, a TIMESTAMP."""
    return bars.withWatermark("at", lateness).dropDuplicatesWithinWatermark(list(keys))


def refresh(bars: DataFrame, sessions: DataFrame, timeframe: str, path: str, checkpoint: str) -> StreamingQuery:
    """A stream of raw bars (symbol_id, ts, ordinal, ...) upserted into the stored candles at ``path`` (``operators/store.py``), all
    that is there, then ended. A batch that is run again stores the same rows, so a restart repeats nothing."""

    def write(batch: DataFrame, _: int) -> None:
        candles, _rejected = normalize(batch, sessions, timeframe, keys=("symbol_id",))
        store.upsert(candles.withColumn("timeframe", F.lit(timeframe)), path)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["CANDLE_KEY", "once_per_key", "refresh", "upsert_candles", "windowed"]
