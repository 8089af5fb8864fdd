"""Indicators over a stream whose bars come late or are corrected.

A symbol's state is a base, the average after all bars that the watermark has passed, and a map of the bars after it. A batch's
bars go into the map, and from the earliest one that is new or has changed the average is worked out again to the newest bar, so
what is emitted for a time replaces what was emitted before. Event-time timers fold bars that can't change any more into the
base, so the state holds the bars of the lateness and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

OUT = "symbol string, at timestamp, ema double, again boolean"


def advance(count: int, value: float, close: float, n: int) -> tuple[int, float]:
    """Count and average after one more bar: the mean of the first ``n`` seeds it."""
    count += 1
    return count, value + close / n if count <= n else value + (close - value) * 2 / (n + 1)


class Replayed(StatefulProcessor):
    """An exponential average of ``n`` bars."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "count long, value double, upto long")
        self.bars = handle.getMapState("bars", "at long", "close double")

    def _held(self) -> dict[int, float]:
        return {k[0]: v[0] for k, v in self.bars.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        count, value, upto = self.base.get() if self.base.exists() else (0, 0.0, -(1 << 62))
        held, changed, new = self._held(), None, set()
        for f in rows:
            for at, close in zip(f["us"].astype("int64").tolist(), f["close"].tolist()):
                if at > upto and close == close and held.get(at) != close:
                    if at not in held:
                        new.add(at)
                        self.handle.registerTimer(at // 1000)
                    held[at] = close
                    self.bars.updateValue((at,), (close,))
                    changed = at if changed is None else min(changed, at)
        out = []
        if changed is not None:
            for at in sorted(held):
                count, value = advance(count, value, held[at], self.n)
                if at >= changed:
                    out.append((key[0], at, value if count >= self.n else None, at not in new))
        frame = pd.DataFrame(out, columns=["symbol", "at", "ema", "again"]).astype({"ema": "float64", "again": "bool", "symbol": "object"})
        yield frame.assign(at=pd.to_datetime(frame["at"].astype("int64"), unit="us", utc=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        count, value, upto = self.base.get() if self.base.exists() else (0, 0.0, -(1 << 62))
        held, passed = self._held(), timerValues.getCurrentWatermarkInMs() * 1000
        for at in sorted(a for a in held if a <= passed):
            count, value = advance(count, value, held[at], self.n)
            upto = at
            self.bars.removeKey((at,))
        self.base.update((count, value, upto))
        yield pd.DataFrame({"symbol": pd.Series([], dtype="object"), "at": pd.to_datetime(pd.Series([], dtype="int64"), utc=True), "ema": pd.Series([], dtype="float64"), "again": pd.Series([], dtype="bool")})

    def close(self) -> None:
        pass


def ema(bars: DataFrame, n: int, lateness: str = "1 hour") -> DataFrame:
    """A stream of bars (symbol, at TIMESTAMP, close) to (symbol, at, ema, again) in update mode: a row for each bar from the earliest
    new or changed one on; ``again`` where its value replaces one emitted before. The average is null before ``n`` bars. Bars that
    come later than ``lateness`` are dropped, null and repeated ones pass without effect. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass)."""
    from pyspark.sql import functions as F

    rows = bars.select("symbol", "at", F.unix_micros("at").alias("us"), F.col("close").cast("double").alias("close")).withWatermark("at", lateness)
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=Replayed(n), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
