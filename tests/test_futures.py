import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.ext import futures

SCHEMA = "root string, contract string, expiry date, ts timestamp_ntz, open double, high double, low double, close double, volume long"


def bars(spark, rows):
    """(contract number, day of January, close, volume); several bars of a day get later hours."""
    seen, out = {}, []
    for k, day, close, volume in rows:
        hour = seen[k, day] = seen.get((k, day), 9) + 1
        out.append(("WIN", f"WIN{k}", dt.date(2024, 2 + k, 1), dt.datetime(2024, 1, day, hour), close - 1.0, close + 1.0, close - 2.0, float(close), volume))
    return spark.createDataFrame(out, SCHEMA)


def series(df):
    return [(r.ts, r.contract, r.close) for r in df.orderBy("ts").collect()]


@pytest.fixture
def three(spark):
    """Three contracts with gaps between them; the second leads from day 4, the third from day 7."""
    rng, rows = np.random.default_rng(3), []
    for k, level in enumerate((100.0, 130.0, 90.0)):
        for day in range(1, 11):
            level += int(rng.integers(-3, 4))
            rows.append((k, day, level, 500 if k == (day >= 4) + (day >= 7) else 100))
    return rows


def test_ratio_keeps_returns_and_difference_keeps_steps(spark, three):
    df = bars(spark, three)
    front = futures.by_volume(df)
    calendar = futures.rolls(df, front)
    rolls = [(r.dy.day, r.from_contract, r.contract, r.common_ts.day) for r in calendar.orderBy("dy").collect()]
    assert rolls == [(4, "WIN0", "WIN1", 3), (7, "WIN1", "WIN2", 6)]
    close = {(k, day): c for k, day, c, _ in three}
    own = [(close[k, day], close.get((k, day - 1))) for day in range(1, 11) for k in [(day >= 4) + (day >= 7)]]
    ratio = [c for _, _, c in series(futures.continuous(df, front, calendar, "ratio"))]
    shifted = [c for _, _, c in series(futures.continuous(df, front, calendar, "difference"))]
    assert len(ratio) == 10 and ratio[-1] == close[2, 10] and shifted[-1] == close[2, 10]  # the newest bars stay
    for i in range(1, 10):
        assert abs(ratio[i] / ratio[i - 1] - own[i][0] / own[i][1]) < 1e-12
        assert abs((shifted[i] - shifted[i - 1]) - (own[i][0] - own[i][1])) < 1e-9
    plain = [c for _, _, c in series(futures.continuous(df, front, calendar, "none"))]
    assert plain == [c for c, _ in own]
    with pytest.raises(ValueError):
        futures.continuous(df, front, calendar, "sideways")


def test_rolls_are_not_taken_back_and_ties_go_to_the_nearer(spark):
    rows = [(0, 1, 10, 5), (1, 1, 20, 5), (0, 2, 10, 1), (1, 2, 20, 9), (0, 3, 10, 99), (1, 3, 20, 1)]
    front = [r.contract for r in futures.by_volume(bars(spark, rows)).orderBy("dy").collect()]
    assert front == ["WIN0", "WIN1", "WIN1"]


def test_contracts_that_never_trade_together(spark):
    rows = [(0, 1, 10, 5), (0, 2, 11, 5), (1, 3, 20, 5), (1, 4, 22, 5)]
    df = bars(spark, rows)
    front = futures.by_volume(df)
    calendar = futures.rolls(df, front)
    assert [(r.ratio, r.difference, r.common_ts) for r in calendar.collect()] == [(None, None, None)]
    assert [c for _, _, c in series(futures.continuous(df, front, calendar))] == [10.0, 11.0, 20.0, 22.0]


def test_intraday_bars_roll_by_day_with_the_last_common_bar(spark):
    rows = [(0, 1, 10, 9), (0, 1, 12, 9), (1, 1, 20, 1), (1, 1, 30, 1), (0, 2, 11, 1), (1, 2, 33, 9), (1, 2, 36, 9)]
    df = bars(spark, rows)
    front = futures.by_volume(df)
    got = series(futures.continuous(df, front, futures.rolls(df, front)))
    assert [c for _, _, c in got] == [25.0, 30.0, 33.0, 36.0]  # 30 / 12


def test_front_by_expiry(spark):
    rows = [(k, day, 10 + k, 1) for k in range(2) for day in (1, 20, 27, 28, 30)]
    front = [(r.dy.day, r.contract) for r in futures.by_expiry(bars(spark, rows), 5).orderBy("dy").collect()]
    assert front == [(1, "WIN0"), (20, "WIN0"), (27, "WIN1"), (28, "WIN1"), (30, "WIN1")]


def test_empty_one_contract_nulls_and_extra_columns(spark):
    empty = bars(spark, [])
    front = futures.by_volume(empty)
    assert futures.continuous(empty, front, futures.rolls(empty, front)).count() == 0
    one = bars(spark, [(0, 1, 10, None), (0, 2, 11, 3)]).withColumns({"note": F.lit("x"), "size": F.lit(1)})
    front = futures.by_volume(one)
    calendar = futures.rolls(one, front)
    assert calendar.count() == 0
    got = futures.continuous(one, front, calendar)
    assert [c for _, _, c in series(got)] == [10.0, 11.0] and {"note", "size"} <= set(got.columns)
