"""Indicators over a stream of bars, with a state of constant size per symbol."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ema(bars: DataFrame, n: int, source: str = "close") -> DataFrame:
    """A stream of bars (symbol, ts, ``source``) to (symbol, ts, ema), a row per bar: the mean of the first ``n`` bars
    seeds the average, and it is null before. The state is a count and a value. Bars of a symbol come in order of time
    from one micro-batch to the next; inside a batch they are sorted. Rows with a null value are passed over."""

    def step(key, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        count, value = state.get if state.exists else (0, 0.0)
        for f in [pd.concat(list(frames)).dropna(subset=[source]).sort_values("ts")]:
            out = []
            for x in f[source]:
                count += 1
                value = value + x / n if count <= n else value + (x - value) * 2 / (n + 1)
                out.append(value if count >= n else None)
            state.update((count, value))
            yield pd.DataFrame({"symbol": key[0], "ts": f["ts"], "ema": pd.Series(out, index=f.index, dtype="float64")})

    rows = bars.select("symbol", "ts", source)
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp_ntz, ema double", "bars long, value double", "append", GroupStateTimeout.NoTimeout)
