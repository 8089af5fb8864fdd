"""Scans over blocks of bars against plain loops, with blocks so small that every series crosses many."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.ext import indicators, scan
from tests.helpers import at, bar, bars


def walk(n, seed=1, symbol="AAAA3", step=0.02):
    """Hourly bars of a random walk with gaps."""
    rng, price, t, rows = np.random.default_rng(seed), 20.0, at("2024-01-29T13:00"), []
    for i in range(n):
        opened = price * (1 + (0.08 if i % 17 == 0 else step) * rng.standard_normal())
        closed = opened * (1 + step * rng.standard_normal())
        high, low = max(opened, closed) * (1 + step * rng.random()), min(opened, closed) * (1 - step * rng.random())
        rows.append(bar(t + dt.timedelta(hours=i), opened, high, low, closed, None, 10, i, symbol))
        price = closed
    return rows


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 4)


def columns(df, *names):
    got = df.orderBy("symbol", "ts").collect()
    return [[r[n] for r in got] for n in names]


def same(got, want):
    return np.allclose([np.nan if v is None else v for v in got], want, equal_nan=True, rtol=1e-9)


def average(values, n, alpha, skip=0):
    out = np.full(len(values), np.nan)
    v = np.asarray(values)[skip:]
    if len(v) >= n:
        e = v[:n].mean()
        out[skip + n - 1] = e
        for i in range(n, len(v)):
            e += alpha * (v[i] - e)
            out[skip + i] = e
    return out


def test_averages_across_blocks_of_blocks(spark, small_blocks):
    rows = walk(150) + walk(3, 2, "BBBB4") + walk(64, 3, "CCCC3")  # 150 bars are 38 blocks, 10 blocks of blocks
    df = bars(spark, *rows).repartition(5)
    got = scan.smoothed(scan.numbered(df), e=("close", 5, 2 / 6, 0), w=("open", 1, 1.0, 0), late=("close", 7, 0.1, 20))
    for symbol in ("AAAA3", "BBBB4", "CCCC3"):
        own = [r for r in rows if r[0] == symbol]
        n, e, w, late = columns(got.where(F.col("symbol") == symbol), "_n", "e", "w", "late")
        assert n == list(range(len(own)))
        close = [r[5] for r in own]
        assert same(e, average(close, 5, 1 / 3)) and same(w, [r[2] for r in own]) and same(late, average(close, 7, 0.1, 20))
    assert scan.smoothed(scan.numbered(df.limit(0)), e=("close", 5, 0.5, 0)).count() == 0


def test_a_null_makes_later_averages_null(spark, small_blocks):
    df = bars(spark, *walk(30)).withColumn("close", F.when(F.col("ordinal") != 11, F.col("close")))
    (e,) = columns(scan.smoothed(scan.numbered(df), e=("close", 3, 0.5, 0)), "e")
    assert all(v is None for v in e[:2]) and all(v is not None for v in e[2:11]) and all(v is None for v in e[11:])


def test_bar_before_across_blocks_and_months(spark, small_blocks):
    rows = walk(90)
    got = scan.before(scan.numbered(bars(spark, *rows)), was="close", top="high")
    was, top = columns(got, "was", "top")
    assert was == [None] + [r[5] for r in rows[:-1]] and top == [None] + [r[3] for r in rows[:-1]]


def test_one_symbol_is_spread_and_stays_in_the_jvm(spark, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = indicators.ema(bars(spark, *walk(400)), 20)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 300, sizes
        for f in (indicators.rsi, indicators.macd, indicators.directional, indicators.parabolic, indicators.supertrend, indicators.zigzag):
            assert "Python" not in f(bars(spark, *walk(40)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def psar(rows, start=0.02, step=0.02, most=0.2):
    high, low, close = ([r[k] for r in rows] for k in (3, 4, 5))
    out = [(None, None)] * min(len(rows), 1)
    for i in range(1, len(rows)):
        if i == 1:
            up = not close[1] < close[0]
            sar, ep, af = (low[0], max(high[:2]), start) if up else (high[0], min(low[:2]), start)
        else:
            sar += af * (ep - sar)
            sar = min(sar, low[i - 1], low[i - 2]) if up else max(sar, high[i - 1], high[i - 2])
            if up and low[i] < sar:
                up, sar, ep, af = False, max(ep, high[i]), low[i], start
            elif not up and high[i] > sar:
                up, sar, ep, af = True, min(ep, low[i]), high[i], start
            elif up and high[i] > ep or not up and low[i] < ep:
                ep, af = (high[i] if up else low[i]), min(af + step, most)
        out.append((sar, up))
    return out


def test_parabolic_across_blocks(spark, small_blocks):
    rows = walk(130, 5) + walk(1, 6, "BBBB4") + walk(2, 7, "CCCC3")
    got = indicators.parabolic(bars(spark, *rows))
    for symbol in ("AAAA3", "BBBB4", "CCCC3"):
        want = psar([r for r in rows if r[0] == symbol])
        line, up = columns(got.where(F.col("symbol") == symbol), "psar", "psar_up")
        assert up == [u for _, u in want] and same(line, [np.nan if v is None else v for v, _ in want])
    ups = columns(got.where("symbol = 'AAAA3'"), "psar_up")[0][1:]
    assert sum(a != b for a, b in zip(ups, ups[1:])) > 5  # it does flip
    assert indicators.parabolic(bars(spark, *rows).limit(0)).count() == 0


def test_parabolic_flips_at_a_gap_to_the_extreme(spark):
    t = at("2024-03-11T13:00")
    prices = [(10, 9), (11, 10), (12, 11), (13, 12), (5, 4), (4, 3), (20, 15)]  # (high, low); a gap down, then one up
    rows = [bar(t + dt.timedelta(hours=i), low, high, low, high, None, 1, i) for i, (high, low) in enumerate(prices)]
    line, up = columns(indicators.parabolic(bars(spark, *rows)), "psar", "psar_up")
    assert up == [None, True, True, True, False, False, True]
    assert line[4] == 13 and line[6] == 3  # the highest high of the rise, the lowest low of the fall


def test_parabolic_of_equal_bars_stays(spark):
    t = at("2024-03-11T13:00")
    line, up = columns(indicators.parabolic(bars(spark, *[bar(t + dt.timedelta(hours=i), 5, 5, 5, 5, None, 1, i) for i in range(8)])), "psar", "psar_up")
    assert up[1:] == [True] * 7 and line[1:] == [5.0] * 7


def trend(rows, n, k):
    spans = [max(r[3] - r[4], *((abs(r[3] - p[5]), abs(r[4] - p[5])) if p else (0, 0))) for p, r in zip([None, *rows], rows)]
    atr, out, state = average(spans, n, 1 / n), [], None
    for r, a in zip(rows, atr):
        if np.isnan(a):
            out.append((np.nan, None))
            continue
        mid = (r[3] + r[4]) / 2
        over, under = mid + k * a, mid - k * a
        if state is None:
            upper, lower, up = over, under, r[5] >= mid
        else:
            u, w, up, before = state
            upper = over if over < u or before > u else u
            lower = under if under > w or before < w else w
            up = not r[5] < lower if up else r[5] > upper
        state = (upper, lower, up, r[5])
        out.append((lower if up else upper, up))
    return out


def test_supertrend_across_blocks(spark, small_blocks):
    rows = walk(140, 8) + walk(5, 9, "BBBB4")
    got = indicators.supertrend(bars(spark, *rows), 6, 1.5)
    for symbol in ("AAAA3", "BBBB4"):
        want = trend([r for r in rows if r[0] == symbol], 6, 1.5)
        line, up = columns(got.where(F.col("symbol") == symbol), "supertrend", "supertrend_up")
        assert up == [u for _, u in want] and same(line, [v for v, _ in want])
    ups = [u for u in columns(got.where("symbol = 'AAAA3'"), "supertrend_up")[0] if u is not None]
    assert sum(a != b for a, b in zip(ups, ups[1:])) > 3
    assert indicators.supertrend(bars(spark, *rows).limit(0)).count() == 0


def legs(rows, t):
    """Confirmed pivots and the open one, bar by bar."""
    out, side = [], 0
    for i, r in enumerate(rows):
        ts, high, low = r[1], r[3], r[4]
        if i == 0:
            top, bottom = (high, ts), (low, ts)
        elif side == 0:
            if high >= bottom[0] * (1 + t):
                out.append(("low", bottom[1], bottom[0], ts))
                side, ext = 1, (high, ts)
            elif low <= top[0] * (1 - t):
                out.append(("high", top[1], top[0], ts))
                side, ext = -1, (low, ts)
            else:
                top, bottom = ((high, ts) if high > top[0] else top), ((low, ts) if low < bottom[0] else bottom)
        elif side == 1:
            if high > ext[0]:
                ext = (high, ts)
            elif low <= ext[0] * (1 - t):
                out.append(("high", ext[1], ext[0], ts))
                side, ext = -1, (low, ts)
        elif low < ext[0]:
            ext = (low, ts)
        elif high >= ext[0] * (1 + t):
            out.append(("low", ext[1], ext[0], ts))
            side, ext = 1, (high, ts)
    return out + ([("high" if side == 1 else "low", ext[1], ext[0], None)] if side else [])


def pivots_of(df):
    return sorted(((r.kind, r.ts, r.price, r.confirmed_ts) for r in df.collect()), key=lambda x: x[1])


def test_zigzag_across_blocks_never_repaints(spark, small_blocks):
    rows = walk(160, 11)
    want = legs(rows, 0.06)
    assert len(want) > 8 and pivots_of(indicators.zigzag(bars(spark, *rows), 0.06)) == sorted(want, key=lambda x: x[1])
    early = [p for p in pivots_of(indicators.zigzag(bars(spark, *rows[:90]), 0.06)) if p[3] is not None]
    assert early == [p for p in sorted(want, key=lambda x: x[1]) if p[3] is not None and p[3] <= rows[89][1]]


def test_zigzag_without_a_reversal_or_with_ties(spark, small_blocks):
    t = at("2024-03-11T13:00")
    flat = [bar(t + dt.timedelta(hours=i), 5, 5, 5, 5, None, 1, i) for i in range(12)]
    assert indicators.zigzag(bars(spark, *flat), 0.05).count() == 0
    tied = [bar(t + dt.timedelta(hours=i), p, p, p, p, None, 1, i) for i, p in enumerate([10, 12, 12, 12, 9, 9, 12])]
    assert pivots_of(indicators.zigzag(bars(spark, *tied), 0.1)) == [("low", tied[0][1], 10.0, tied[1][1]), ("high", tied[1][1], 12.0, tied[4][1]), ("low", tied[4][1], 9.0, tied[6][1]), ("high", tied[6][1], 12.0, None)]
