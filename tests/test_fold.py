import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from candlespark.functions import calendar as C
from candlespark.operators import fold, gaps, read
from tests.helpers import at, bar, bars


@pytest.fixture(scope="module")
def days(spark):
    return C.sessions(spark, "2024-03-11", "2024-03-15").cache()


def series(start="2024-03-11T13:00", n=84, skip=(), first=0):
    t = at(start)
    return [bar(t + dt.timedelta(minutes=5 * i), 10 + i, 12 + i, 9 + i, 11 + i, None if i % 3 else 10.0 + i, i, first + i) for i in range(n) if i not in skip]


def test_normalize_drops_with_the_first_reason_and_folds_in_stable_order(spark, days):
    raw = bars(
        spark,
        bar("2024-03-11T13:02", 10, 12, 9, 11, 5.0, 1, 2), bar("2024-03-11T13:02", 20, 21, 19, 20, None, 2, 3), bar("2024-03-11T13:00", 8, 9, 7, 8, -1.0, 4, 9),
        bar("2024-03-11T12:59:59"), bar("2024-03-11T20:00"), bar("2024-03-16T15:00"), bar("2024-03-12T15:00", o=0.0, h=-1.0), bar("2024-03-12T15:00", h=9.0), bar("2024-03-12T15:00", v=-1), bar(None),
    )
    candles, rejected = fold.normalize(raw, days, "5m")
    (c,) = candles.collect()
    assert (c.ts, c.open, c.high, c.low, c.close, c.adj_close, c.volume) == (at("2024-03-11T13:00"), 8, 21, 7, 20, 5.0, 7)
    assert sorted(r.reject_reason for r in rejected.collect()) == sorted(["before the session opens", "after the session closes", "not a trading day", "open not positive", "high below open or close", "negative volume", "missing timestamp"])


def test_daily_bars_take_any_instant_of_the_day(spark, days):
    candles, _ = fold.normalize(bars(spark, bar("2024-03-11T03:00"), bar("2024-03-12T23:00")), days, "1d")
    assert sorted(r.ts for r in candles.collect()) == [at("2024-03-11T13:00"), at("2024-03-12T13:00")]


@pytest.mark.parametrize(("tf", "n"), [("15m", 28), ("30m", 14), ("1h", 7)])
def test_resample_conserves_and_counts(spark, days, tf, n):
    base = bars(spark, *series())
    out = fold.resample(base, days, tf)
    rows = out.orderBy("ts").collect()
    assert len(rows) == n and rows[0].open == 10 and rows[-1].close == 94
    assert sum(r.volume for r in rows) == sum(range(84)) and max(r.high for r in rows) == 95 and min(r.low for r in rows) == 9
    assert read.reconcile(base, out).first().verdict == "ok"


def test_resample_twice_equals_once_and_names_the_bucket_open(spark, days):
    base = bars(spark, *series(skip=(0, 13)))
    once = {tuple(r) for r in fold.resample(base, days, "1h").collect()}
    assert once == {tuple(r) for r in fold.resample(fold.resample(base, days, "15m").withColumn("volume", F.col("volume")), days, "1h").collect()}
    assert min(r[1] for r in once) == at("2024-03-11T13:00")


def test_resample_is_strict(spark, days):
    for rows, why in ((series()[:2] + [bar("2024-03-11T13:07", k=9)], "5m grid"), (series()[:2] + [bar("2024-03-11T13:05", k=9)], "out of time order"), ([bar("2024-03-16T15:00")], "outside its session"), ([bar("2024-03-11T13:00", low=-1.0)], "low not positive")):
        with pytest.raises(Exception, match=why):
            fold.resample(bars(spark, *rows), days, "1h").collect()
    with pytest.raises(ValueError, match="stored"):
        fold.resample(bars(spark, *series()), days, "1d")
    with pytest.raises(ValueError, match="known"):
        fold.resample(bars(spark, *series()), days, "2h")


def test_pages_concatenate_to_the_whole_fold(spark, days):
    base = bars(spark, *series(), *series("2024-03-12T13:00", skip=(5,), first=100)).cache()
    whole = sorted((r.ts, r.volume) for r in fold.resample(base, days, "1h").collect())
    got, before = [], None
    for _ in range(20):
        rows = read.page(base, days, "AAAA3", "1h", "2024-03-01 00:00:00", "2024-04-01 00:00:00", before, limit=3).collect()
        got = [(r.ts, r.volume) for r in rows] + got
        if not rows or not rows[0].has_more:
            break
        before = str(rows[0].cursor)
    assert got == whole
    assert read.clamp_limit(None) == 1000 and read.clamp_limit(9999) == 5000 and read.base_cap("1h", 10) == 121 and read.base_cap("5m", 10) == 11


def test_gap_report(spark, days):
    rows = series(skip=(3, 4)) + [bar("2024-03-16T15:00"), bar("2024-03-12T13:00", symbol="BBBB3")]
    symbols = spark.createDataFrame([("AAAA3",), ("BBBB3",), ("CCCC3",)], "symbol string")
    got = {r.symbol: r for r in gaps.report(bars(spark, *rows), days, "5m", symbols).collect()}
    a, c = got["AAAA3"], got["CCCC3"]
    assert (a.sessions, a.expected, a.bars, a.missing, a.partial, a.unexpected, a.clean, a.empty) == (5, 420, 82, 4, 1, 1, False, False)
    assert c.empty and not c.clean
    assert gaps.universe(gaps.report(bars(spark, *rows), days, "5m", symbols)).first().dirty == 3
    with pytest.raises(ValueError):
        gaps.report(bars(spark, *rows), days, "1h", symbols)


def test_partial_only_is_clean(spark):
    one = C.sessions(spark, "2024-03-11", "2024-03-11")
    symbols = spark.createDataFrame([("AAAA3",)], "symbol string")
    assert gaps.report(bars(spark, *series(skip=(1,))), one, "5m", symbols).first().clean


def test_columnar_round_trip_and_preview(spark, days):
    base = bars(spark, *series())
    body = read.columnar(base)
    assert body.first().ts[:2] == [1710162000, 1710162300]
    assert read.rows_of(body).count() == 84
    assert read.head_and_tail(base).count() == 40 and read.head_and_tail(bars(spark, *series(n=30))).count() == 30
    assert read.earliest_latest(base.limit(0)).count() == 0


def test_order_is_exact_for_large_ordinals_and_parts_of_a_second(spark, days):
    big = 1 << 62
    rows = [bar("2024-03-11T13:00", 5, 9, 4, 6, 1.0, 1, big + 1), bar("2024-03-11T13:00", 7, 9, 4, 8, None, 1, big), bar("2024-03-11T13:00:00.000002", 6, 9, 4, 7, 2.0, 1, 0), bar("2024-03-11T13:00:00.000001", 6, 9, 4, 5, 3.0, 1, 5 + (1 << 20))]
    (c,) = fold.normalize(bars(spark, *rows), days, "5m")[0].collect()
    assert (c.open, c.close, c.adj_close, c.volume) == (7, 7, 2.0, 4)
    far = [bar("2024-03-11T13:00", 5, 9, 4, 6, None, 1, (1 << 20) + 3), bar("2024-03-11T13:00", 8, 9, 4, 7, None, 1, 4)]
    (c,) = fold.normalize(bars(spark, *far), days, "5m")[0].collect()
    assert (c.open, c.close) == (8, 6)


TICK = "symbol string, ts timestamp_ntz, price double, volume long, ordinal long"


def test_bad_ticks_are_set_apart_and_candles_stay_valid(spark, days):
    rows = [("A", at("2024-03-11T13:00"), p, v, i) for i, (p, v) in enumerate([(0.0, 1), (5.0, 2), (float("nan"), 1), (None, 1), (6.0, -1), (7.0, 3), (-2.0, 1)])]
    ticks = spark.createDataFrame(rows + [("A", at("2024-03-11T12:00"), 3.0, 1, 9), ("A", None, 3.0, 1, 9), ("A", at("2024-03-16T15:00"), 3.0, 1, 9)], TICK)
    (c,) = fold.fold_ticks(ticks, days, "5m").collect()
    assert (c.open, c.high, c.low, c.close, c.volume, c.ticks) == (5.0, 7.0, 5.0, 7.0, 5, 2)
    why = {r.reject_reason: r["count"] for r in fold.tagged_ticks(ticks, days, "5m").groupBy("reject_reason").count().collect()}
    assert why == {None: 2, "price not positive": 4, "negative volume": 1, "outside the session": 1, "missing timestamp": 1, "not a trading day": 1}
    assert fold.resample(fold.fold_ticks(ticks, days, "5m").withColumn("adj_close", F.lit(None).cast("double")), days, "1h").count() == 1


@pytest.mark.parametrize("tf", ["5m", "15m", "1h"])
def test_repeated_times_are_refused_without_an_ordinal(spark, days, tf):
    rows = bars(spark, *series()[:6], bar("2024-03-11T13:10")).drop("ordinal")
    with pytest.raises(Exception, match="repeated time"):
        fold.resample(rows, days, tf).collect()
    assert fold.resample(bars(spark, *series()).drop("ordinal"), days, tf).count() == {"5m": 84, "15m": 28, "1h": 7}[tf]
    assert fold.resample(rows, days, "15m", strict=False).count() == 1


def test_pages_fold_strictly_and_compare_instants(spark, days):
    get = lambda rows, before=None, tf="1h": read.page(bars(spark, *rows), days, "AAAA3", tf, "2024-03-01T00:00", "2024-04-01 00:00:00", before, limit=3).collect()
    for odd in (bar("2024-03-16T15:00", k=99), bar("2024-03-12T13:00", low=-3.0, k=99), bar("2024-03-12T13:01", k=99)):
        with pytest.raises(Exception, match="can't be folded"):
            get([*series(), odd])
    assert [r.ts for r in get(series(), "2024-03-11T15:00")] == [r.ts for r in get(series(), "2024-03-11 15:00:00")] == [at("2024-03-11T13:00"), at("2024-03-11T14:00")]
    assert len(get(series(), "2024-03-11T11:00:00-03:00")) == 1 and get(series(), "2024-02-01") == []
    rows = get(series(), tf="5m")
    assert len(rows) == 3 and rows[0].has_more and rows[0].cursor == at("2024-03-11T19:45")


def test_page_bodies(spark, days):
    page = read.page(bars(spark, *series()), days, "AAAA3", "1h", "2024-03-01", "2024-04-01", limit=3)
    (r,) = read.page_body(page, "AAAA3", "1h", "2024-04-01", "2024-03-20").collect()
    body = json.loads(r.body)
    assert (body["symbol"], body["base"], body["count"], body["next_cursor"], r.cache_control) == ("AAAA3", "5m", 3, "2024-03-11T17:00:00Z", "no-cache")
    assert len(body["ts"]) == len(body["v"]) == 3 and len(r.etag) == 66
    (r,) = read.page_body(page.limit(0), "AAAA3", "1h", "2024-03-10", "2024-03-10").collect()
    assert json.loads(r.body) == {"symbol": "AAAA3", "timeframe": "1h", "base": "5m", "count": 0, "ts": [], "o": [], "h": [], "l": [], "c": [], "v": []} and "immutable" in r.cache_control
    assert spark.range(1).select(read.cache_policy().alias("c")).first().c == "public, max-age=300"
