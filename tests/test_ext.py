import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from candlespark.ext import backtest, indicators, rules
from tests.helpers import at, bar, bars


def closes(spark, values):
    t = at("2024-03-11T13:00")
    return bars(spark, *[bar(t + dt.timedelta(hours=i), v, v + 1, v - 1, v, None, 10, i) for i, v in enumerate(values)])


def average(values, n, alpha):
    out = np.full(len(values), np.nan)
    out[n - 1] = np.mean(values[:n])
    for i in range(n, len(values)):
        out[i] = out[i - 1] + alpha * (values[i] - out[i - 1])
    return out


def test_windowed_indicators(spark):
    rows = closes(spark, [1.5, 2.5, 3.5, 4.5]).select("ts", indicators.sma(F.col("close"), 2).alias("sma"), indicators.wma(F.col("close"), 2).alias("wma"), indicators.momentum(F.col("close"), 2).alias("m")).orderBy("ts").collect()
    assert [r.sma for r in rows] == [None, 2.0, 3.0, 4.0] and abs(rows[1].wma - (1.5 + 5) / 3) < 1e-9 and rows[3].m == 2


def test_recursive_indicators(spark):
    values = [float(10 + (i * 7) % 5) for i in range(40)]
    got = np.array([r.ema if r.ema is not None else np.nan for r in indicators.ema(closes(spark, values), 5).orderBy("ts").collect()])
    want, e = [np.nan] * 4 + [np.mean(values[:5])], np.mean(values[:5])
    for v in values[5:]:
        e += (v - e) * 2 / 6
        want.append(e)
    assert np.allclose(got, want, equal_nan=True)
    rsi = [r.rsi for r in indicators.rsi(closes(spark, [float(i + 2) for i in range(20)]), 14).orderBy("ts").collect()]
    assert rsi[-1] == 100.0 and np.isnan(rsi[13] if rsi[13] is not None else np.nan)
    line = average(values, 12, 2 / 13) - average(values, 26, 2 / 27)
    signal = np.concatenate([np.full(25, np.nan), average(line[25:], 9, 2 / 10)])
    got = indicators.macd(closes(spark, values)).orderBy("ts").toPandas()
    assert np.allclose(got["macd"], line, equal_nan=True) and np.allclose(got["macd_signal"], signal, equal_nan=True) and np.allclose(got["macd_histogram"], line - signal, equal_nan=True)
    v = np.array(values)
    span = np.concatenate([[2.0], np.maximum(2.0, np.maximum(np.abs(v[1:] + 1 - v[:-1]), np.abs(v[1:] - 1 - v[:-1])))])
    assert np.allclose(indicators.atr(closes(spark, values), 3).orderBy("ts").toPandas()["atr"].astype(float), average(span, 3, 1 / 3), equal_nan=True)


def test_rules_and_backtest(spark):
    c = closes(spark, [10.0, 11.0, 9.0, 12.0, 13.0, 8.0, 9.0])
    rule = rules.compile_rule({"all": [{"op": "gt", "left": "close", "right": 8.5}, {"not": {"op": "lt", "left": "close", "right": {"ref": "close", "back": 1}}}, {"any": [{"op": "rising", "left": "close"}, {"op": "eq", "left": "close", "right": 0}]}]})
    assert [r.x for r in c.select("ts", F.coalesce(rule, F.lit(False)).alias("x")).orderBy("ts").collect()] == [False, True, False, True, True, False, True]
    signals = c.withColumn("enter", F.col("close") == 11.0).withColumn("leave", F.col("close") == 13.0)
    (t,) = backtest.backtest(signals, quantity=10).collect()
    assert (t.entry_cents, t.exit_cents, t.reason) == (9000, 8000, "signal")
    (t,) = backtest.backtest(signals, quantity=10, stop=0.05, target=0.01).collect()
    assert t.reason == "stop"
    m = backtest.metrics(backtest.backtest(signals, quantity=10)).first()
    assert m.trades == 1 and m.profit_cents == -1000
    assert [round(r.drawdown, 3) for r in backtest.drawdown(c, "close").orderBy("ts").collect()][2] == 0.182
    grid = spark.createDataFrame([("a", 11.0), ("b", 99.0)], "run_id string, level double")
    swept = backtest.sweep(c, grid, lambda x: x.withColumn("enter", F.col("close") == F.col("level")).withColumn("leave", F.col("close") == 13.0), quantity=10)
    assert [r.run_id for r in swept.collect()] == ["a"]


def test_indicators_of_too_few_bars_are_null(spark):
    c = closes(spark, [10.0, 11.0, 9.0])
    for f, column in ((indicators.dema_tema, "tema"), (indicators.keltner, "upper"), (indicators.stochastic_rsi, "stoch_rsi"), (indicators.directional, "adx"), (indicators.money_flow, "mfi"), (indicators.hull, "hma"), (indicators.historical_volatility, "hv")):
        values = [r[0] for r in f(c).select(column).collect()]
        assert len(values) == 3 and all(v is None or np.isnan(v) for v in values), column
        assert f(c.limit(0)).count() == 0


def test_fractals_and_pivots(spark):
    rows = closes(spark, [10.0, 11.0, 15.0, 12.0, 11.0, 11.0]).select("ts", *indicators.fractals(2), *indicators.pivots()).orderBy("ts").collect()
    assert [r.fractal_high for r in rows] == [False, False, True, False, False, False] and not any(r.fractal_low for r in rows)
    assert rows[0].pivot is None and (rows[1].pivot, rows[1].r1, rows[1].s1, rows[1].r2, rows[1].s2) == (10.0, 11.0, 9.0, 12.0, 8.0)


def test_return_metrics(spark):
    values = [100.0, 110.0, 99.0, 120.0]
    m = backtest.return_metrics(closes(spark, values).select("symbol", "ts", F.col("close").alias("equity")), periods=3).first()
    steps = np.diff(values) / values[:-1]
    assert m.steps == 3 and abs(m.total_return - 0.2) < 1e-12 and abs(m.cagr - 0.2) < 1e-12 and abs(m.max_drawdown - 0.1) < 1e-12 and abs(m.calmar - 2) < 1e-9
    assert abs(m.sharpe - steps.mean() / steps.std(ddof=1) * 3**0.5) < 1e-9 and abs(m.sortino - steps.mean() / np.sqrt((np.minimum(steps, 0) ** 2).mean()) * 3**0.5) < 1e-9
    one = backtest.return_metrics(closes(spark, [5.0]), "close").first()
    assert one.steps == 0 and one.total_return == 0 and one.cagr is None and one.sharpe is None and one.calmar is None
