import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlespark.functions import bars as B
from candlespark.functions import tickers as K
from candlespark.functions import params
from candlespark.operators import ingest, runs, store, universe, upsert
from candlespark.schemas import parse_kind, parse_timeframe
from tests.helpers import at


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in rows.select(f(F.col("x"))).collect()]


def test_classify(spark):
    names = ["PETR4", "petr3 ", "KLBN11", "AAPL34", "ROXO36", "^BVSP", "BTC-USD", "WINZ25", "WIN", "XYZF24", "", "PETR9"]
    assert column(spark, names, K.classify) == ["stock", "stock", "unit", "bdr", None, "index", "crypto", "future", "future", None, None, None]
    assert column(spark, ["stock", "index", "fii"], K.default_lot) == [100, 1, 1]


def test_texts(spark):
    assert column(spark, ["a, B,,c "], K.split_list)[0] == ["A", "B", "C"]
    assert column(spark, [["a", "b", "c"], ["a"]], lambda c: K.join_list(c, 2), "array<string>") == ["a, b and 1 more", "a"]
    assert column(spark, ["A B", "AB", "A?"], K.valid_ticker) == [False, True, False]
    assert column(spark, [92, 93, 5000], K.intraday_range, "int") == ["3mo", "6mo", "max"]
    assert column(spark, ["FGH", "FA", ""], K.months_ok) == [True, False, False]
    assert column(spark, ['"x", W/"t"', "*", '"x"'], lambda c: K.etag_matches(c, F.lit('"t"'))) == [True, True, False]
    with pytest.raises(ValueError):
        K.check_intraday_range("1mo")
    with pytest.raises(ValueError, match="stock"):
        parse_kind("bond")
    assert parse_timeframe(" 1H ") == "1h"


def test_display_name(spark):
    rows = [("A", None, None), ("A", "a", " "), ("A", "Short", None), ("A", "Short", " Long ")]
    got = spark.createDataFrame(rows, "t string, s string, l string").select(K.display_name(F.col("t"), F.col("s"), F.col("l"))).collect()
    assert [r[0] for r in got] == ["A", "A", "Short", "Long"]


def test_epoch_or_text(spark):
    texts = ["1710162000", "2024-03-11T10:00:00-03:00", "2024-03-11T13:00:00Z", "nonsense", None]
    assert column(spark, texts, B.from_epoch_or_text) == [at("2024-03-11T13:00")] * 3 + [None, None]


SYMBOLS = "ticker string, long_name string, kind string, active boolean, tracked boolean"


def test_search_is_literal_and_ranked(spark):
    s = spark.createDataFrame([("ABCD3", "x", "stock", True, False), ("XAB11", None, "unit", True, True), ("ZZZZ3", "cab co", "stock", True, True), ("A%B3", None, "stock", True, True)], SYMBOLS)
    assert [r.ticker for r in universe.search(s, "ab").collect()] == ["ABCD3", "XAB11", "ZZZZ3"]
    assert [r.ticker for r in universe.search(s, "%").collect()] == ["A%B3"]
    assert universe.search(s, "", "unit").count() == 1 and universe.search(s, "", "", 2).count() == 2


def test_plan(spark):
    admitted = spark.createDataFrame([("PETR4",), ("WIN",)], "ticker string")
    futures = spark.createDataFrame([("WIN", "Mini", "Mini c", 0.2, 5.0, 1)], "root string, name string, long_name string, point_value double, tick_size double, lot_size int")
    seeds = spark.createDataFrame([("PETR4", "fii", "", "P", "USD", None, None, None, False), ("^BVSP", "", "I", "", "", None, 1.0, None, True)], "ticker string, kind string, short_name string, long_name string, currency string, lot_size int, tick_size double, point_value double, tracked boolean")
    want = universe.desired(admitted, futures, seeds)
    d = {r.ticker: r for r in want.collect()}
    assert d["PETR4"].kind == "fii" and d["PETR4"].lot_size == 1 and d["PETR4"].currency == "USD"
    assert d["WIN"].tracked and d["^BVSP"].tracked and d["^BVSP"].kind == "index"
    existing = spark.createDataFrame([("PETR4", True), ("GONE3", True), ("OLD3", False)], "ticker string, tracked boolean")
    plan = {r.ticker: (r.created, r.admitted) for r in universe.admission(want, existing).collect()}
    assert plan == {"PETR4": (False, False), "WIN": (True, True), "^BVSP": (True, True)}
    assert [r.ticker for r in universe.departures(existing, admitted, want).collect()] == ["GONE3"]
    again = want.select("ticker", "tracked")
    assert universe.admission(want, again).where("created OR admitted").count() == 0
    with pytest.raises(ValueError):
        universe.stale(existing.withColumn("active", F.lit(True)).withColumn("kind", F.lit("stock")), admitted.limit(0))


CANDLES = "symbol_id long, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long"


def candle(i, close=1.0, adj=None, tf="5m", symbol=1):
    return (symbol, tf, at("2024-03-11T13:00") + dt.timedelta(minutes=5 * i), 1.0, 2.0, 0.5, close, adj, 10)


def test_upsert_keeps_adj_close_and_is_idempotent(spark, tmp_path):
    old = spark.createDataFrame([candle(0, adj=7.0), candle(1)], CANDLES)
    new = spark.createDataFrame([candle(0, close=1.5), candle(2, tf="1d")], CANDLES)
    path = str(tmp_path / "candles")
    assert store.read(spark, path).count() == 0 and store.upsert(old, path) == 1
    first = store.listing(spark, path, 1)
    assert store.upsert(spark.createDataFrame([(1, "5m", at("2024-05-02T13:00"), 1.0, 2.0, 0.5, 1.0, None, 10)], CANDLES), path) == 2
    second = store.listing(spark, path, 2)
    assert sorted(second) == [("5m", "2024-03"), ("5m", "2024-05")] and second["5m", "2024-03"] == first["5m", "2024-03"]  # the other month isn't written
    with pytest.raises(ValueError, match="stored"):
        store.upsert(spark.createDataFrame([candle(0, tf="1h")], CANDLES), path)
    with pytest.raises(ValueError, match="time"):
        store.upsert(spark.createDataFrame([(1, "5m", None, 1.0, 2.0, 0.5, 1.0, None, 10)], CANDLES), path)
    assert store.upsert(new.limit(0), path) == 2
    for _ in range(2):
        store.upsert(new, path)
        got = {(r.timeframe, r.ts.minute): (r.close, r.adj_close) for r in store.read(spark, path, months=["2024-03"]).collect()}
        assert got == {("5m", 0): (1.5, 7.0), ("5m", 5): (1.0, None), ("1d", 10): (1.0, None)}
    assert store.read(spark, path, timeframe="5m").count() == 3 and store.read(spark, path, version=1).count() == 2
    assert upsert.constraint_breaks(spark.createDataFrame([candle(0), candle(0), candle(1, tf="1h"), candle(2, close=9.0)], CANDLES)).count() == 3


def test_deactivate_and_run_states_and_ids(spark):
    s = spark.createDataFrame([("A", True), ("B", False)], "ticker string, active boolean")
    got = {r.ticker: (r.active, r.changed) for r in upsert.deactivate(s, s).collect()}
    assert got == {"A": (False, True), "B": (False, False)}
    events = spark.createDataFrame([(1, 1, "running"), (1, 2, "ok")], "id long, seq long, status string")
    assert runs.run_states(events).first().status == "ok"
    known = spark.createDataFrame([(4,)], "id long")
    assert upsert.with_ids(s.withColumn("id", F.lit(None).cast("long")), known).orderBy("ticker").select("id").collect()[0].id == 5


def test_ingest_plan(spark):
    w = ingest.chunk_windows(spark, "2024-01-01", "2024-01-25", 10).orderBy("w_start").collect()
    assert [(r.w_start.day, r.w_end.day) for r in w] == [(1, 10), (11, 20), (21, 25)]
    symbols = spark.createDataFrame([(1, "PETR4"), (2, "XXXX3")], "symbol_id long, ticker string")
    windows = ingest.chunk_windows(spark, "2024-01-01", "2024-01-25", 10)
    runs = spark.createDataFrame([(1, "5m", dt.date(2023, 12, 1), dt.date(2024, 1, 12), "ok")], "symbol_id long, timeframe string, range_start date, range_end date, status string")
    clean = spark.createDataFrame([(1, dt.date(2024, 1, 21))], "symbol_id long, w_start date")
    plan = ingest.backfill_plan(symbols, windows, clean, runs, "5m", "2024-02-01", has_token=False)
    assert {(r.symbol_id, r.w_start.day): r.action for r in plan.collect()} == {(1, 1): "skip", (1, 11): "fetch", (1, 21): "skip", (2, 1): "unreachable", (2, 11): "unreachable", (2, 21): "unreachable"}
    assert ingest.backfill_plan(symbols, windows, clean, runs, "5m", "2024-02-01", force=True).where("action = 'fetch'").count() == 6
    assert ingest.usage_window(dt.date(2024, 2, 10)) == (dt.date(2024, 2, 1), dt.date(2024, 2, 29))


def test_json_bodies_tell_open_from_closed_windows(spark):
    from pyspark.sql import functions as F

    from candlespark.operators import read

    ends = [("A", "2024-03-11 10:00:00"), ("B", "2024-03-11 12:00:00"), ("C", "2024-03-11 12:00:01")]
    pages = spark.createDataFrame(ends, "symbol string, until string").select("*", *[F.array(F.lit(1)).alias(c) for c in ("ts", "o", "h", "l", "c", "v")])
    got = read.json_bodies(pages, now="2024-03-11 12:00:00", end=F.col("until"))
    assert {r.symbol: r.closed for r in got.collect()} == {"A": True, "B": True, "C": False} and got.columns == ["symbol", "body", "etag", "closed", "cache_control"]
    assert not any(r.closed for r in read.json_bodies(pages, now="2024-03-11 12:00:00", end="2024-03-12 00:00:00").collect())
    assert read.json_bodies(pages).columns == ["symbol", "body", "etag"]


def test_lookup_and_job_symbols(spark):
    s = spark.createDataFrame([(1, "ABCD3", "stock", True), (2, "WIN", "future", True), (3, "ZZZZ3", "stock", False)], "id long, ticker string, kind string, tracked boolean")
    assert universe.symbol_of(s, " abcd3 ").first().id == 1
    with pytest.raises(LookupError):
        universe.symbol_of(s, "NONE3")
    assert [r.ticker for r in universe.listing(s).collect()] == ["ABCD3", "WIN", "ZZZZ3"] and universe.listing(s, tracked=True).count() == 2
    assert [r.ticker for r in universe.resolve(s).collect()] == ["ABCD3"] and universe.resolve(s, "zzzz3, WIN").count() == 2
    for bad, error in ((" , ", ValueError), ("ABCD3,QQQQ3", LookupError)):
        with pytest.raises(error):
            universe.resolve(s, bad)
    with pytest.raises(LookupError):
        universe.resolve(s.where("id = 3"))
    assert universe.enrichable(s, False).count() == 0 and [r.id for r in universe.enrichable(s, True).orderBy("id").collect()] == [1, 3]
    candles = spark.createDataFrame([candle(0), candle(1, symbol=3)], CANDLES)
    assert [r.symbol for r in universe.candles_of(candles, s, "ZZZZ3").collect()] == ["ZZZZ3"]


def test_request_parameters():
    day = dt.date(2024, 1, 2)
    assert params.whole_number(None, "limit", 7) == 7 and params.whole_number(" 12 ", "limit", 7) == 12
    assert params.day("", "from", day) == day and params.day("2024-02-29", "from", day) == dt.date(2024, 2, 29)
    assert params.moment("2024-03-11T10:00:00-03:00", "cursor") == at("2024-03-11T13:00") and params.moment(" ", "cursor") is None
    assert params.in_order(day, day) == (day, day)
    for f in (lambda: params.whole_number("0", "limit", 1), lambda: params.whole_number("1.5", "limit", 1), lambda: params.day("2024-2-9", "from", day), lambda: params.day("20240209xx", "from", day), lambda: params.moment("2024-03-11 10:00:00", "cursor"), lambda: params.moment("2024-03-11T10:00:00", "cursor"), lambda: params.in_order(day, dt.date(2024, 1, 1))):
        with pytest.raises(ValueError):
            f()


def test_runs_open_close_and_list(spark):
    chunks = spark.createDataFrame([(1, "5m", dt.date(2024, 1, 1), dt.date(2024, 1, 5)), (2, "5m", dt.date(2024, 1, 1), dt.date(2024, 1, 5)), (3, "5m", dt.date(2024, 1, 1), dt.date(2024, 1, 5))], "symbol_id long, timeframe string, range_start date, range_end date")
    begun = runs.opened(chunks, "2024-01-06 10:00:00", spark.createDataFrame([(40,)], "id long"))
    assert {r.status for r in runs.run_states(begun).collect()} == {"running"} and [r.id for r in begun.orderBy("id").collect()] == [41, 42, 43]
    results = spark.createDataFrame([(1, "5m", dt.date(2024, 1, 1), 1 << 40, 2, None, None), (2, "5m", dt.date(2024, 1, 1), 0, 0, None, None), (3, "5m", dt.date(2024, 1, 1), 0, 0, "denied", 403)], "symbol_id long, timeframe string, range_start date, bars long, rejected long, error string, http_status int")
    now = runs.run_states(begun.unionByName(runs.closed(begun, results, "2024-01-06 10:00:02.25"))).cache()
    assert {r.id: (r.status, r.bars, r.error, r.http_status, r.duration_ms) for r in now.collect()} == {41: ("ok", (1 << 31) - 1, None, None, 2250), 42: ("empty", 0, None, None, 2250), 43: ("failed", 0, "denied", 403, 2250)}
    assert [r.id for r in runs.history(now, 3, "5m", 5).collect()] == [43] and [r.id for r in runs.recent_failures(now, "2024-01-06 10:00:00", 5).collect()] == [43]
    used = spark.createDataFrame([(dt.date(2024, 1, 3), 5), (dt.date(2024, 2, 3), 7)], "day date, requests long")
    assert runs.usage_total(used, "2024-01-01", "2024-01-31", 50).first() == (5, 10.0) and runs.usage_total(used, "2025-01-01", "2025-01-31").first().requests == 0


def test_backfill_requests_and_chunks(spark):
    (w,) = ingest.backfill_windows(spark, "5m", "2024-01-02", "2024-01-30", "2024-03-01").collect()
    assert (w.range, w.keep_from, w.keep_to) == ("3mo", at("2024-01-02T03:00"), at("2024-01-31T03:00"))
    assert ingest.backfill_windows(spark, "1d", "2022-01-02", "2024-01-30", "2024-03-01").count() == 3 and ingest.backfill_windows(spark, "1d", "2022-01-02", "2024-01-30", "2024-03-01", token="5y").count() == 1
    for bad in (("1h", "2024-01-02", "2024-01-30"), ("5m", "2024-01-30", "2024-01-02")):
        with pytest.raises(ValueError):
            ingest.backfill_windows(spark, *bad, "2024-03-01")
    with pytest.raises(ValueError):
        ingest.backfill_windows(spark, "5m", "2024-01-02", "2024-01-30", "2024-03-01", token="1mo")
    from candlespark.functions import calendar as C

    sessions = C.sessions(spark, "2024-03-01", "2024-03-29")
    symbols = spark.createDataFrame([(1, "PETR4"), (2, "VALE3"), (3, "MGLU3"), (4, "XXXX3")], "symbol_id long, ticker string")
    plan = ingest.sync_plan(symbols, sessions, "5m", "2024-03-12", 2, has_token=False)
    day = dt.date(2024, 3, 11)
    rows = [(s, day, at(t), 10.0, 11.0, 9.0, low, None, 1, 0) for s, t, low in ((1, "2024-03-11T13:00", 10.0), (1, "2024-03-08T13:00", 10.0), (1, "2024-03-11T13:05", 99.0), (2, "2024-03-08T13:00", 10.0), (3, "2024-03-11T13:00", 10.0))]
    bars = spark.createDataFrame(rows, "symbol_id long, w_start date, ts timestamp_ntz, open double, high double, low double, close double, adj_close double, volume long, ordinal long")
    errors = spark.createDataFrame([(3, day, "answered 500", 500)], "symbol_id long, w_start date, error string, http_status int")
    kept, rejected, results = ingest.run_chunks(plan, bars, errors, sessions, "5m")
    assert {r.symbol_id: (r.status, r.bars, r.rejected) for r in results.collect()} == {1: ("ok", 1, 1), 2: ("empty", 0, 0), 3: ("failed", 0, 0)}
    assert kept.count() == 1 and rejected.count() == 1
    counts = ingest.plan_counts(plan, False, results).first()
    assert (counts.symbols, counts.requests, counts.unreachable, counts.bars, counts.empty, counts.failed) == (4, 3, 1, 1, 1, 1)
    assert {r.status: (r.tickers, r["first"]) for r in ingest.first_of(results, "status", 1).collect()}["failed"] == (1, ["MGLU3"])


def test_rejection_sample_is_the_first_three_in_time(spark):
    rows = [("A", at(f"2024-03-11T13:0{m}"), k, f"r{m}{k}") for m in (3, 1, 2) for k in (2, 1)]
    (r,) = ingest.rejection_sample(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, ordinal long, reject_reason string")).collect()
    assert r.rejected == 6 and r.reasons == ["2024-03-11T13:01:00Z: r11", "2024-03-11T13:01:00Z: r12", "2024-03-11T13:02:00Z: r21"]
