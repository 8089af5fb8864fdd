"""Backtests, walk-forward analysis and portfolios against plain loops, in blocks so small that every series crosses many."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from candlespark.ext import backtest, indicators, portfolio, scan
from tests.helpers import at, bar, bars
from tests.test_scan import walk

T0 = at("2024-03-11T13:00")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 8)


def candles(spark, prices, symbol="AAAA3"):
    """Bars of (open, high, low, close)."""
    return [bar(T0 + dt.timedelta(hours=i), *p, None, 1, i, symbol) for i, p in enumerate(prices)]


def signalled(spark, rows, enter, leave):
    return bars(spark, *rows).withColumns({"enter": F.col("ordinal").isin(*enter), "leave": F.col("ordinal").isin(*leave)})


def trades(df):
    return [(r.entry_cents, r.exit_cents, r.reason, r.ambiguous) for r in df.orderBy("entry_ts").collect()]


def test_ticks_round_against_the_trade(spark):
    rows = candles(spark, [(10, 10, 10, 10), (10.02, 10.1, 10, 10), (10.03, 10.1, 10, 10), (10.08, 10.1, 10, 10)])
    df = signalled(spark, rows, [0], [2])
    assert trades(backtest.backtest(df, quantity=1, tick=0.05)) == [(1005, 1005, "signal", False)]  # 10.02 up to 10.05, 10.08 down to 10.05
    assert trades(backtest.backtest(df, quantity=1, tick=0.01)) == [(1002, 1008, "signal", False)]  # prices on the grid stay
    assert trades(backtest.backtest(df, quantity=1, tick=0.05, slippage_bps=50)) == [(1010, 1000, "signal", False)]


def test_stops_and_targets_on_the_grid(spark):
    # entry 10.00; a stop of 3.3 % is 9.67, down to 9.65; a target of 3.3 % is 10.33, up to 10.35
    for low, high, want in ((9.66, 10.1, []), (9.65, 10.1, [(1000, 965, "stop", False)]), (9.9, 10.34, []), (9.9, 10.35, [(1000, 1035, "target", False)]), (9.0, 11.0, [(1000, 965, "stop", True)])):
        rows = candles(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (10, high, low, 10)])
        assert trades(backtest.backtest(signalled(spark, rows, [0], []), quantity=1, tick=0.05, stop=0.033, target=0.033)) == want
    gap = candles(spark, [(10, 10, 10, 10), (10, 10, 10, 10), (9.02, 9.5, 9, 9)])
    assert trades(backtest.backtest(signalled(spark, gap, [0], []), quantity=1, tick=0.05, stop=0.033)) == [(1000, 900, "stop", False)]


def test_positions_sold_at_the_end(spark):
    df = signalled(spark, candles(spark, [(10, 10, 10, 10)] * 12), [9], [])
    assert trades(backtest.backtest(df, quantity=1)) == []
    assert trades(backtest.backtest(df, quantity=1, close_at_end=True)) == [(1000, 1000, "end", False)]
    late = signalled(spark, candles(spark, [(10, 10, 10, 10)] * 12), [11], [])
    assert trades(backtest.backtest(late, quantity=1, close_at_end=True)) == []  # its signal would fill after the end
    assert backtest.backtest(df.limit(0), close_at_end=True).count() == 0


def looped(rows, enter, leave, stop, target):
    out, held, pending = [], None, None
    for i, r in enumerate(rows):
        o, h, low = r[2], r[3], r[4]
        done = None
        if pending == "enter" and held is None:
            held = o
        elif pending == "leave" and held is not None:
            done = (o, "signal")
        if held is not None and done is None:
            if low <= held * (1 - stop):
                done = (min(o, held * (1 - stop)), "stop")
            elif h >= held * (1 + target):
                done = (max(o, held * (1 + target)), "target")
        if done:
            out.append((round(held * 100), round(done[0] * 100), done[1]))
            held = None
        pending = "leave" if i in leave else "enter" if i in enter else None
    return out


def test_many_trades_across_blocks(spark):
    rng, rows = random.Random(4), walk(200, 21)
    enter, leave = set(rng.sample(range(200), 50)), set(rng.sample(range(200), 30))
    got = [x[:3] for x in trades(backtest.backtest(signalled(spark, rows, enter, leave), quantity=1, stop=0.04, target=0.06))]
    assert got == looped(rows, enter, leave, 0.04, 0.06) and len(got) > 20


def crossing(rows):
    mean = indicators.sma(F.col("close"), 3)
    rows = rows.withColumn("m", mean)
    return rows.withColumns({"enter": F.coalesce(F.col("close") > F.col("m") * F.col("k"), F.lit(False)), "leave": F.coalesce(F.col("close") < F.col("m"), F.lit(False))})


def test_sweep_keeps_symbols_of_any_name(spark):
    grid = spark.createDataFrame([(1, 1.0), (2, 99.0)], "run_id int, k double")
    rows = walk(40, 1, "A|B|7")
    got = backtest.sweep(bars(spark, *rows), grid, crossing, quantity=1).collect()
    assert got and {(r.symbol, r.run_id) for r in got} == {("A|B|7", 1)}


def test_windows_roll_over_days(spark):
    got = backtest.windows(bars(spark, *walk(24 * 9, 2)), 4, 2).collect()  # 10 days, as it begins at 13:00
    days = sorted({r.dy for r in got})
    by = {w: ([days.index(r.dy) for r in sorted(got, key=lambda r: r.dy) if (r.window, r.role) == (w, "train")], [days.index(r.dy) for r in sorted(got, key=lambda r: r.dy) if (r.window, r.role) == (w, "test")]) for w in {r.window for r in got}}
    assert by == {0: ([0, 1, 2, 3], [4, 5]), 1: ([2, 3, 4, 5], [6, 7]), 2: ([4, 5, 6, 7], [8, 9])}
    assert backtest.windows(bars(spark, *walk(24, 2)), 4, 2).count() == 0


def test_walk_forward_uses_no_later_bar(spark):
    grid = spark.createDataFrame([(1, 1.0), (2, 1.01), (3, 1.02)], "run_id int, k double")
    rows = walk(24 * 7, 31, step=0.03)
    got = backtest.walk_forward(bars(spark, *rows), grid, crossing, 3, 1, quantity=1).orderBy("exit_ts").collect()
    assert got and got[-1].equity_cents == sum(r.profit_cents for r in got)
    days = sorted({r[1].date() for r in rows})
    for r in got:
        assert r.entry_ts.date() == r.exit_ts.date() == days[r.window + 3]
    # what follows a window changes neither its choice nor its trades
    cut = days[5]
    altered = [x if x[1].date() < cut else (*x[:2], *(v * 1.7 for v in x[2:6]), *x[6:]) for x in rows]
    again = backtest.walk_forward(bars(spark, *altered), grid, crossing, 3, 1, quantity=1).orderBy("exit_ts").collect()
    early = lambda rs: [tuple(r) for r in rs if r.exit_ts.date() < cut]
    assert early(got) and early(got) == early(again)
    # the choice is the best of the training days
    for w in {r.window for r in got}:
        mine = {d: [x for x in rows if x[1].date() == d] for d in days[w : w + 3]}
        assert len(mine) == 3
        profits = {}
        for run in (1, 2, 3):
            one = crossing(bars(spark, *rows).withColumn("k", F.lit(1.0 + (run - 1) / 100))).where(F.col("ts").cast("date").isin(*mine))
            profits[run] = sum(r.profit_cents for r in backtest.backtest(one, quantity=1, close_at_end=True).collect())
        assert {(r.run_id, r.train_cents) for r in got if r.window == w} == {(min(profits, key=lambda k: (-profits[k], k)), max(profits.values()))}
        break


def weights(spark, rows):
    return spark.createDataFrame([(T0 + dt.timedelta(days=d), s, p, w) for d, s, p, w in rows], "ts timestamp_ntz, symbol string, price double, weight double")


def replayed(rows, cash, lot, fee):
    """A plain loop over the times."""
    held, out = {}, []
    for d in sorted({r[0] for r in rows}):
        now = {s: (round(p * 100), w) for dd, s, p, w in rows if dd == d}
        held = {s: (q, now[s][0] if s in now else c) for s, (q, c) in held.items()}
        worth = cash + sum(q * c for q, c in held.values())
        free = worth - sum(q * c for s, (q, c) in held.items() if s not in now)
        share, fees, orders = free * (1 - 2 * fee / 1e4), 0, {}
        for s, (c, w) in now.items():
            to = math.floor(share * w / c / lot) * lot
            step = to - held.get(s, (0, 0))[0]
            cost = math.floor(abs(step * c) * fee / 1e4)
            if step:
                orders[s] = step
                cash, fees = cash - step * c - cost, fees + cost
            held.pop(s, None)
            if to:
                held[s] = (to, c)
        out.append((cash, worth - fees, fees, orders, {s: q for s, (q, _) in held.items()}))
    return out


def test_portfolio_conserves_cash_to_the_cent(spark):
    rng, rows = random.Random(9), []
    price = {s: 20.0 + i for i, s in enumerate("ABCDE")}
    for d in range(40):
        chosen = rng.sample("ABCDE", 2)
        for s in "ABCDE":
            price[s] *= 1 + rng.uniform(-0.05, 0.05)
            if rng.random() > 0.15:  # else it doesn't trade that day
                rows.append((d, s, round(price[s], 2), 0.5 if s in chosen else 0.0))
    got = portfolio.rebalanced(weights(spark, rows), 1_000_000, lot=10, fee_bps=3.25).orderBy("ts").collect()
    want = replayed(rows, 1_000_000, 10, 3.25)
    assert [(r.cash_cents, r.equity_cents, r.fees_cents, {o.symbol: o.quantity for o in r.orders}, {h.symbol: h.quantity for h in r.held}) for r in got] == want
    spent = sum(o.quantity * o.cents + o.fee for r in got for o in r.orders)
    assert 1_000_000 - spent == got[-1].cash_cents and all(r.cash_cents >= 0 for r in got)
    assert all(r.equity_cents == r.cash_cents + sum(h.quantity * h.cents for h in r.held) for r in got)
    assert all(o.quantity % 10 == 0 for r in got for o in r.orders)


def test_portfolio_odd_rows(spark):
    assert portfolio.rebalanced(weights(spark, []), 100).count() == 0
    got = portfolio.rebalanced(weights(spark, [(0, "A", 10.0, 1.0), (0, "B", None, 0.5), (0, "C", -1.0, 0.5), (1, "B", 5.0, None)]), 10_500).orderBy("ts").collect()
    assert [(r.cash_cents, r.equity_cents) for r in got] == [(500, 10_500), (500, 10_500)] and [h.symbol for h in got[1].held] == ["A"]


def test_targets_look_one_bar_back_and_break_ties_by_symbol(spark):
    rows = []
    for s in "BAC":
        rows += candles(spark, [(10, 11, 9, 10), (10, 11, 9, 12 if s == "C" else 10), (10, 11, 9, 10)], s)
    got = portfolio.targets(bars(spark, *rows), F.col("close"), 1).where("weight > 0").orderBy("ts").collect()
    assert [(r.symbol, r.ts.hour, r.weight) for r in got] == [("A", 14, 1.0), ("C", 15, 1.0)]
