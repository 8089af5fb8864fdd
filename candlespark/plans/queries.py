"""Registered queries over the driver's tables, each with the SQL that it must agree with."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.ext import backtest, futures, indicators, portfolio, rules, scan
from candlespark.functions import bars as B
from candlespark.functions import calendar as C
from candlespark.functions import tickers as K
from candlespark.operators import fold, gaps, ingest, read, runs, store, universe, upsert
from candlespark.plans import adapters as A
from candlespark.schemas import ZONE, width

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Parts of the oracle's SQL: sessions and ticks of January 2024, ticks inside sessions, 5m candles.
UTC_OF = "CAST(timezone('UTC', timezone('America/Sao_Paulo', {})) AS TIMESTAMP)"
LOCAL_OF = "timezone('America/Sao_Paulo', timezone('UTC', {}))"
SESS_OF = f"""sess AS (
  SELECT CAST(d AS DATE) AS dy,
         {UTC_OF.format("d + CASE WHEN CAST(d AS DATE) = DATE '2024-01-25' THEN INTERVAL 13 HOUR ELSE INTERVAL 10 HOUR END")} AS open_ts,
         {UTC_OF.format("d + INTERVAL 17 HOUR")} AS close_ts
  FROM {{}} g(d)
  WHERE isodow(d) < 6 AND CAST(d AS DATE) <> DATE '2024-01-01')"""
SESS = SESS_OF.format("generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)")
TICKS = """t AS (
  SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume, event_id AS ordinal
  FROM events)"""
GOOD = "t.price > 0 AND NOT coalesce(t.volume < 0, false)"
PLACED = f"p AS (SELECT t.*, s.* FROM t JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy AND t.ts >= s.open_ts AND t.ts < s.close_ts AND {GOOD})"
BY_PLACE = "ORDER BY {t}ts, {t}ordinal"


def first_last(value: str, t: str = "") -> str:
    """First and last value by (ts, ordinal)."""
    order = BY_PLACE.format(t=t)
    return f"first({value} {order}) AS open, max({value}) AS high, min({value}) AS low, last({value} {order}) AS close"



def bucket(tf: str) -> str:
    """The oracle's bucket expression."""
    return "open_ts" if tf == "1d" else f"time_bucket(INTERVAL {width(tf) // 60} MINUTE, ts, open_ts)"


def candles_sql(tf: str, name: str = "c") -> str:
    """CTE of candles of a timeframe folded from ticks."""
    return f"""{name} AS (
  SELECT symbol, {bucket(tf)} AS ts, {first_last("price")},
         CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks
  FROM p GROUP BY ALL)"""


def with_(*parts: str) -> str:
    """A WITH clause."""
    return "WITH " + ",\n".join(parts) + "\n"


BASE = with_(SESS, TICKS, PLACED, candles_sql("5m"))
HOURLY_SPANS = with_(SESS, TICKS, PLACED, candles_sql("1h"))


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def candles(spark, sf_dir: str, tf: str = "5m") -> DataFrame:
    """Candles folded from ticks."""
    return fold.fold_ticks(A.ticks(spark, sf_dir), A.january(spark), tf)


def base(spark, sf_dir: str) -> DataFrame:
    """5m candles with an empty adj_close, as stored ones."""
    return candles(spark, sf_dir).withColumn("adj_close", F.lit(None).cast("double"))


for _tf in ("5m", "15m", "30m", "1h"):
    query(f"resample_{_tf}", with_(SESS, TICKS, PLACED, candles_sql(_tf)) + "SELECT * FROM c")(lambda spark, d, tf=_tf: candles(spark, d, tf))
for _tf in ("15m", "30m", "1h"):
    _folded = f"""f AS (
  SELECT c.symbol, time_bucket(INTERVAL {width(_tf) // 60} MINUTE, c.ts, s.open_ts) AS ts, arg_min(open, c.ts) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, c.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM c JOIN sess s ON CAST({LOCAL_OF.format('c.ts')} AS DATE) = s.dy GROUP BY ALL)"""
    query(f"refold_{_tf}", BASE.rstrip() + ",\n" + _folded + "\nSELECT * FROM f")(lambda spark, d, tf=_tf: fold.resample(base(spark, d), A.january(spark), tf).drop("adj_close"))


DAILY = with_(SESS, TICKS, f"c AS (SELECT t.symbol, s.open_ts AS ts, {first_last("price", "t.")}, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS ticks FROM t JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy AND {GOOD} GROUP BY ALL)")


@query("daily_session_open", DAILY + "SELECT * FROM c")
def _(spark, d):
    return candles(spark, d, "1d")


TAGGED = with_(
    SESS,
    TICKS,
    f"""b AS (
  SELECT t.*, s.open_ts, s.close_ts, CASE WHEN ordinal % 97 = 0 THEN 0.0 ELSE price END AS low,
         CASE WHEN ordinal % 11 = 0 OR ordinal % 13 = 0 THEN NULL ELSE price END AS adj,
         CASE WHEN ordinal % 89 = 0 THEN -1 ELSE volume END AS vol
  FROM t LEFT JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy)""",
    """g AS (
  SELECT *, CASE WHEN open_ts IS NULL THEN 'not a trading day' WHEN ts < open_ts THEN 'before the session opens'
                 WHEN ts >= close_ts THEN 'after the session closes' WHEN price <= 0 THEN 'open not positive' WHEN low <= 0 THEN 'low not positive' WHEN vol < 0 THEN 'negative volume' END AS reject_reason
  FROM b)""",
)


@query("rejects_by_reason", TAGGED + "SELECT reject_reason, count(*) AS bars FROM g WHERE reject_reason IS NOT NULL GROUP BY 1")
def _(spark, d):
    return fold.normalize(A.raw_bars(spark, d), A.january(spark), "5m")[1].groupBy("reject_reason").agg(F.count("*").alias("bars"))


@query("normalize_clean", TAGGED + f"SELECT symbol, {bucket('5m')} AS ts, first(price ORDER BY ts, ordinal) AS open, max(price) AS high, min(low) AS low, last(price ORDER BY ts, ordinal) AS close, last(adj ORDER BY ts, ordinal) FILTER (WHERE adj IS NOT NULL) AS adj_close, CAST(sum(vol) AS BIGINT) AS volume FROM g WHERE reject_reason IS NULL GROUP BY symbol, {bucket('5m')}")
def _(spark, d):
    return fold.normalize(A.raw_bars(spark, d), A.january(spark), "5m")[0]


@query("ingest_results", TAGGED + f"SELECT symbol, CASE WHEN count(DISTINCT CASE WHEN reject_reason IS NULL THEN {bucket('5m')} END) > 0 THEN 'ok' ELSE 'empty' END AS status, count(DISTINCT CASE WHEN reject_reason IS NULL THEN {bucket('5m')} END) AS bars, CAST(count_if(reject_reason IS NOT NULL) AS BIGINT) AS rejected, array_to_string((list(strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ': ' || reject_reason ORDER BY ts, ordinal) FILTER (WHERE reject_reason IS NOT NULL))[1:3], ' | ') AS reasons FROM g GROUP BY symbol")
def _(spark, d):
    return ingest.ingest(A.raw_bars(spark, d), A.january(spark), "5m")[2].withColumn("reasons", F.array_join("reasons", " | "))


@query("tick_rejects", with_(SESS, TICKS) + f"SELECT symbol, CASE WHEN s.dy IS NULL THEN 'not a trading day' WHEN t.ts < open_ts OR t.ts >= close_ts THEN 'outside the session' WHEN NOT coalesce(price > 0, false) THEN 'price not positive' ELSE 'negative volume' END AS reject_reason, count(*) AS ticks FROM t LEFT JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy WHERE s.dy IS NULL OR t.ts < open_ts OR t.ts >= close_ts OR NOT coalesce({GOOD}, false) GROUP BY ALL")
def _(spark, d):
    rows = fold.tagged_ticks(A.ticks(spark, d), A.january(spark), "5m").where("reject_reason IS NOT NULL")
    return rows.groupBy("symbol", "reject_reason").agg(F.count("*").alias("ticks"))


@query("daily_normalize", "WITH o AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dy, o_totalprice AS p, o_orderkey AS k, o_orderdate + INTERVAL 12 HOUR AS ts FROM orders) SELECT symbol, " + UTC_OF.format("CAST(dy AS TIMESTAMP) + INTERVAL 10 HOUR") + " AS ts, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, count(*) AS bars FROM o WHERE isodow(dy) < 6 AND p > 0 GROUP BY symbol, dy")
def _(spark, d):
    sessions = C.sessions(spark, "1992-01-01", "2002-12-31")
    return fold.normalize(A.daily_bars(spark, d), sessions, "1d")[0].withColumnRenamed("volume", "bars").drop("adj_close")


@query("off_session_ticks", with_(SESS, TICKS) + f"SELECT t.symbol, t.ts FROM t LEFT JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy WHERE s.dy IS NULL OR t.ts < s.open_ts OR t.ts >= s.close_ts")
def _(spark, d):
    return gaps.unexpected(A.ticks(spark, d), A.january(spark))


SEEN_DAYS = f"seen AS (SELECT DISTINCT CAST({LOCAL_OF.format('ts')} AS DATE) AS dy FROM events)"


def seen_days(spark, d) -> DataFrame:
    """The local days that have ticks."""
    return A.ticks(spark, d).select(C.local_day(F.col("ts")).alias("dy")).distinct()


def seen_span(spark, d) -> tuple:
    """The first and the last local day with ticks."""
    return tuple(seen_days(spark, d).agg(F.min("dy"), F.max("dy")).first())


CALENDAR_DAYS = "(SELECT unnest(generate_series(CAST(least(DATE '2024-01-01', min(dy)) AS TIMESTAMP), CAST(greatest(DATE '2024-01-31', max(dy)) AS TIMESTAMP), INTERVAL 1 DAY)) FROM seen)"


@query("sessions", with_(SEEN_DAYS, SESS_OF.format(CALENDAR_DAYS)) + "SELECT * FROM sess")
def _(spark, d):
    """All sessions of the calendar, whether they have ticks or not; ticks beyond its span extend it."""
    ends = [dt.date.fromisoformat(A.FIRST), dt.date.fromisoformat(A.LAST), *(day for day in seen_span(spark, d) if day)]
    return C.sessions(spark, min(ends), max(ends), A.holidays(spark))


@query("trading_days", with_(SESS, SEEN_DAYS) + "SELECT dy FROM sess WHERE dy BETWEEN (SELECT min(dy) FROM seen) AND (SELECT max(dy) FROM seen)")
def _(spark, d):
    return C.trading_days(spark, *seen_span(spark, d), A.holidays(spark))


@query("next_prev_day", with_(SESS, SEEN_DAYS) + "SELECT s.* FROM (SELECT dy, lag(dy) OVER (ORDER BY dy) AS prev_day, lead(dy) OVER (ORDER BY dy) AS next_day FROM sess) s SEMI JOIN seen USING (dy)")
def _(spark, d):
    return C.neighbours(A.january(spark)).join(seen_days(spark, d), "dy", "left_semi")


@query("session_buckets", with_(SESS, SEEN_DAYS) + "SELECT dy, tf, count(*) AS buckets, max(b) AS last_bucket FROM (SELECT dy, '15m' AS tf, unnest(generate_series(open_ts, close_ts - INTERVAL 1 SECOND, INTERVAL 15 MINUTE)) AS b FROM sess SEMI JOIN seen USING (dy) UNION ALL SELECT dy, '1h', unnest(generate_series(open_ts, close_ts - INTERVAL 1 SECOND, INTERVAL 1 HOUR)) FROM sess SEMI JOIN seen USING (dy)) GROUP BY ALL")
def _(spark, d):
    s = A.january(spark).join(seen_days(spark, d), "dy", "left_semi")
    both = [s.select("dy", F.lit(tf).alias("tf"), F.explode(C.buckets_of(tf, F.col("open_ts"), F.col("close_ts"))).alias("b")) for tf in ("15m", "1h")]
    return both[0].unionByName(both[1]).groupBy("dy", "tf").agg(F.count("*").alias("buckets"), F.max("b").alias("last_bucket"))


@query("refresh_window", with_(SESS, SEEN_DAYS) + "SELECT min(dy) AS start_day, max(dy) AS end_day FROM (SELECT dy FROM sess WHERE dy <= (SELECT max(dy) FROM seen) ORDER BY dy DESC LIMIT 5)")
def _(spark, d):
    return C.refresh_window(spark, seen_span(spark, d)[1], 5, A.holidays(spark))


@query("calendar_coverage", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS dy, year(o_orderdate) = 1995 OR year(o_orderdate) = 1996 AS covered FROM orders")
def _(spark, d):
    days = A.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("dy")).distinct()
    marks = spark.createDataFrame([("1995-03-01", "A"), ("1996-03-01", "B")], "day string, name string").withColumn("day", F.col("day").cast("date"))
    return C.covered_days(days, marks)


@query("nearest_sessions", with_(SESS, SEEN_DAYS) + "SELECT dy, (SELECT min(dy) FROM sess WHERE sess.dy > q.dy) AS next_day, (SELECT max(dy) FROM sess WHERE sess.dy < q.dy) AS prev_day FROM seen q")
def _(spark, d):
    first, last = seen_span(spark, d)
    return C.nearest_sessions(spark, seen_days(spark, d), A.january(spark), first, last, strict=False)


@query("day_bounds", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS dy, " + UTC_OF.format("CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)") + " AS start_ts, " + UTC_OF.format("CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP)") + " AS end_ts FROM orders")
def _(spark, d):
    days = A.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("dy")).distinct()
    a, b = C.day_bounds(F.col("dy"), F.col("dy"))
    return days.select("dy", a.alias("start_ts"), b.alias("end_ts"))


WINDOW = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20'"


@query("list_asc", BASE + f"SELECT * FROM c WHERE symbol = 'click' AND {WINDOW} ORDER BY ts LIMIT 50")
def _(spark, d):
    return read.list_candles(candles(spark, d), "click", "2024-01-08", "2024-01-20", 50)


@query("list_desc", BASE + f"SELECT * FROM c WHERE symbol = 'click' AND {WINDOW} ORDER BY ts DESC LIMIT 50")
def _(spark, d):
    return read.list_candles(candles(spark, d), "click", "2024-01-08", "2024-01-20", 50, newest=True)


@query("list_timestamps", BASE + f"SELECT ts FROM c WHERE symbol = 'click' AND {WINDOW}")
def _(spark, d):
    return read.timestamps(candles(spark, d), "click", "2024-01-08", "2024-01-20")


@query("earliest_latest", BASE + "SELECT symbol, min(ts) AS first_ts, arg_min(close, ts) AS first_close, max(ts) AS last_ts, arg_max(close, ts) AS last_close, count(*) AS bars FROM c GROUP BY symbol")
def _(spark, d):
    return read.earliest_latest(candles(spark, d))


@query("count_in_range", BASE + f"SELECT symbol, count(*) AS bars FROM c WHERE {WINDOW} GROUP BY symbol")
def _(spark, d):
    return read.between(candles(spark, d), "2024-01-08", "2024-01-20").groupBy("symbol").agg(F.count("*").alias("bars"))


def page_sql(before: str) -> str:
    """The oracle of a page of ten 1h candles of one symbol before a cursor."""
    return BASE.rstrip() + f""",
n AS (SELECT * FROM c WHERE symbol = 'view' AND ts >= TIMESTAMP '2024-01-01 03:00:00' AND ts < {before} ORDER BY ts DESC LIMIT 121),
f AS (
  SELECT n.symbol, time_bucket(INTERVAL 60 MINUTE, n.ts, s.open_ts) AS ts, arg_min(open, n.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, n.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM n JOIN sess s ON CAST({LOCAL_OF.format('n.ts')} AS DATE) = s.dy GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn, row_number() OVER (ORDER BY ts) AS ra, count(*) OVER () AS b, (SELECT count(*) FROM n) = 121 AS full_cut FROM f),
k AS (SELECT * FROM r WHERE rn <= 10 AND NOT (full_cut AND ra = 1))
SELECT symbol, ts, open, high, low, close, volume, full_cut OR b > 10 AS has_more, CASE WHEN full_cut OR b > 10 THEN min(ts) OVER () END AS cursor FROM k"""


@query("page_1h", page_sql("TIMESTAMP '2024-02-01 03:00:00'"))
def _(spark, d):
    return read.page(base(spark, d), A.january(spark), "view", "1h", "2024-01-01 03:00:00", "2024-02-01 03:00:00", limit=10).drop("adj_close")


@query("page_second", page_sql("TIMESTAMP '2024-01-19 13:00:00'"))
def _(spark, d):
    return read.page(base(spark, d), A.january(spark), "view", "1h", "2024-01-01 03:00:00", "2024-02-01 03:00:00", before="2024-01-19 13:00:00", limit=10).drop("adj_close")


def page_body_sql(before: str) -> str:
    """The oracle of that page as one row of joined arrays."""
    inner = page_sql(before)
    return f"""SELECT 'view' AS symbol, '1h' AS timeframe, '5m' AS base, CAST(count(*) AS INTEGER) AS count, coalesce(string_agg(CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR), ',' ORDER BY ts), '') AS ts,
       coalesce(string_agg(CAST(volume AS VARCHAR), ',' ORDER BY ts), '') AS v, strftime(max(cursor), '%Y-%m-%dT%H:%M:%SZ') AS next_cursor,
       CASE WHEN {before} <= TIMESTAMP '2024-01-25 00:00:00' THEN 'public, max-age=86400, immutable' ELSE 'no-cache' END AS cache_control
FROM ({inner})"""


def joined_arrays(one: DataFrame) -> DataFrame:
    """A page's row with its whole-number arrays as texts."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return one.select("symbol", "timeframe", "base", "count", text("ts"), text("v"), "next_cursor", "cache_control")


@query("page_body", page_body_sql("TIMESTAMP '2024-02-01 03:00:00'"))
def _(spark, d):
    page = read.page(base(spark, d), A.january(spark), "view", "1h", "2024-01-01 03:00:00", "2024-02-01 03:00:00", limit=10)
    return joined_arrays(read.arrays_of_page(page, "view", "1h", "2024-02-01 03:00:00", "2024-01-25 00:00:00"))


@query("page_body_closed", page_body_sql("TIMESTAMP '2024-01-19 13:00:00'"))
def _(spark, d):
    page = read.page(base(spark, d), A.january(spark), "view", "1h", "2024-01-01 03:00:00", "2024-02-01 03:00:00", before="2024-01-19T13:00", limit=10)
    return joined_arrays(read.arrays_of_page(page, "view", "1h", "2024-01-19T13:00", "2024-01-25 00:00:00"))


@query("cache_policy", HOURLY_SPANS + "SELECT symbol, CASE WHEN max(ts) + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-25 00:00:00' THEN 'public, max-age=86400, immutable' ELSE 'no-cache' END AS cache_control, max(ts) + INTERVAL 1 HOUR AS until FROM c GROUP BY symbol, dayofmonth(ts)")
def _(spark, d):
    ends = candles(spark, d, "1h").groupBy("symbol", F.dayofmonth("ts").alias("dy")).agg((F.max("ts") + F.expr("interval 1 hour")).alias("until"))
    closed = F.col("until") <= F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    return ends.select("symbol", read.cache_policy(closed).alias("cache_control"), "until")


@query("older_rows", page_sql("TIMESTAMP '2024-02-01 03:00:00'").replace(" FROM k", " FROM k WHERE ts < TIMESTAMP '2024-01-31 16:00:00'"))
def _(spark, d):
    page = read.page(base(spark, d), A.january(spark), "view", "1h", "2024-01-01 03:00:00", "2024-02-01 03:00:00", limit=10).drop("adj_close")
    return read.without_loaded(page, page.where("ts >= timestamp_ntz'2024-01-31 16:00:00'"))


@query("buckets_and_bars", BASE.rstrip() + f""",
b AS (SELECT DISTINCT c.symbol, time_bucket(INTERVAL 60 MINUTE, c.ts, s.open_ts) AS ts FROM c JOIN sess s ON CAST({LOCAL_OF.format('c.ts')} AS DATE) = s.dy)
SELECT b.symbol, b.ts, count(*) AS bars, max(c.high) AS high FROM b JOIN c ON c.symbol = b.symbol AND c.ts >= b.ts AND c.ts < b.ts + INTERVAL 60 MINUTE GROUP BY ALL""")
def _(spark, d):
    b = base(spark, d)
    return fold.with_bars(fold.resample(b, A.january(spark), "1h"), b, A.january(spark), "1h").groupBy("symbol", "ts").agg(F.count("*").alias("bars"), F.max("bar_high").alias("high"))


@query("head_tail_preview", BASE + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS INTEGER) AS place, count(*) OVER (PARTITION BY symbol) AS total FROM c) WHERE total <= 40 OR place <= 20 OR place > total - 20")
def _(spark, d):
    return read.head_and_tail(candles(spark, d))


GRID = BASE.rstrip() + f""",
e AS (SELECT DISTINCT symbol FROM t),
n AS (SELECT symbol, CAST({LOCAL_OF.format('ts')} AS DATE) AS dy, count(*) AS present FROM c GROUP BY ALL),
g AS (
  SELECT e.symbol, s.dy, CAST(ceil(epoch(close_ts - open_ts) / 300) AS BIGINT) AS expected, coalesce(n.present, 0) AS present
  FROM e CROSS JOIN sess s LEFT JOIN n ON n.symbol = e.symbol AND n.dy = s.dy),
h AS (SELECT *, CASE WHEN present = 0 THEN 'missing' WHEN present < expected THEN 'partial' ELSE 'complete' END AS state FROM g)
"""


@query("gap_sessions", GRID + "SELECT * FROM h")
def _(spark, d):
    return gaps.per_session(candles(spark, d), A.january(spark), "5m", A.ticks(spark, d))


REPORT = GRID.rstrip() + ",\nr AS (SELECT symbol, count(*) AS sessions, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(present) AS BIGINT) AS bars, CAST(count_if(state = 'missing') AS BIGINT) AS missing, CAST(count_if(state = 'partial') AS BIGINT) AS partial, CAST(0 AS BIGINT) AS unexpected, count_if(state = 'missing') = 0 AS clean, sum(present) = 0 AS empty FROM h GROUP BY symbol)\n"


@query("gap_report", REPORT + "SELECT * FROM r")
def _(spark, d):
    return gaps.report(candles(spark, d), A.january(spark), "5m", A.ticks(spark, d))


@query("gap_universe", REPORT + "SELECT count(*) AS symbols, CAST(count_if(NOT clean) AS BIGINT) AS dirty, CAST(count_if(empty) AS BIGINT) AS empty_symbols, CAST(sum(bars) AS BIGINT) AS bars FROM r")
def _(spark, d):
    return gaps.universe(gaps.report(candles(spark, d), A.january(spark), "5m", A.ticks(spark, d)))


@query("gap_lists", GRID + "SELECT symbol, array_to_string(list_sort(list(dy) FILTER (WHERE state = 'missing'))[1:10], ',') AS missing_days, CAST(count_if(state = 'missing') AS INTEGER) AS missing, CAST(count_if(state = 'partial') AS INTEGER) AS partial FROM h GROUP BY symbol")
def _(spark, d):
    rows = gaps.lists(candles(spark, d), A.january(spark), "5m", A.ticks(spark, d))
    return rows.select("symbol", F.array_join(F.transform("missing_days", lambda x: x.cast("string")), ",").alias("missing_days"), "missing", "partial")


@query("fold_reconcile", BASE + "SELECT symbol, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, max(high) AS high, min(low) AS low, 'ok' AS verdict FROM c GROUP BY symbol")
def _(spark, d):
    b = base(spark, d)
    return read.reconcile(b, fold.resample(b, A.january(spark), "1h")).select("symbol", "bars", "volume", "high", "low", "verdict")


@query("intraday_vs_daily", with_(SESS, TICKS, PLACED) + f"SELECT i.symbol, i.dy, i.high = x.high AND i.low = x.low AS same_range, i.close = x.close AS same_close FROM (SELECT symbol, dy, max(price) AS high, min(price) AS low, last(price ORDER BY ts, ordinal) AS close FROM p GROUP BY ALL) i JOIN (SELECT t.symbol, s.dy, max(price) AS high, min(price) AS low, last(price ORDER BY t.ts, t.ordinal) AS close FROM t JOIN sess s ON CAST({LOCAL_OF.format('t.ts')} AS DATE) = s.dy AND {GOOD} GROUP BY ALL) x ON i.symbol = x.symbol AND i.dy = x.dy")
def _(spark, d):
    day = C.local_day(F.col("ts"))
    intraday = candles(spark, d).withColumn("dy", day).groupBy("symbol", "dy").agg(F.max("high").alias("ih"), F.min("low").alias("il"), F.max_by("close", "ts").alias("ic"))
    daily = candles(spark, d, "1d").withColumn("dy", day)
    return intraday.join(daily, ["symbol", "dy"]).select("symbol", "dy", ((F.col("ih") == F.col("high")) & (F.col("il") == F.col("low"))).alias("same_range"), (F.col("ic") == F.col("close")).alias("same_close"))


UNIVERSE = """u0 AS (
  SELECT p_partkey AS k, p_name, p_brand,
         chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey // 26) % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey // 676) % 26 AS INTEGER)) || chr(CAST(65 + (p_partkey // 7) % 26 AS INTEGER)) AS root
  FROM part),
u1 AS (
  SELECT *, CASE WHEN k % 50 = 0 THEN '^' || root WHEN k % 51 = 0 THEN 'WINZ' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') WHEN k % 52 = 0 THEN root || '-USD'
                 ELSE root || (['3', '4', '11', '34', '5', '99'])[k % 6 + 1] END AS ticker
  FROM u0),
u2 AS (SELECT ticker, k, CASE WHEN k % 5 = 0 THEN NULL ELSE p_name END AS long_name, CASE WHEN k % 3 = 0 THEN ticker WHEN k % 4 = 0 THEN '  ' ELSE p_brand END AS short_name, k % 2 = 0 AS tracked, k % 7 <> 0 AS active FROM u1),
u AS (SELECT ticker, min(k) AS id, arg_min_null(long_name, k) AS long_name, arg_min_null(short_name, k) AS short_name, bool_or(tracked) AS tracked, bool_or(active) AS active FROM u2 GROUP BY ticker),
v AS (
  SELECT *, CASE WHEN regexp_full_match(ticker, '\\^[A-Z0-9]{3,6}') THEN 'index' WHEN regexp_full_match(ticker, '[A-Z0-9]{2,10}-[A-Z]{3}') THEN 'crypto'
       WHEN regexp_full_match(ticker, '[A-Z]{4}(31|32|33|34|35|39)') THEN 'bdr' WHEN regexp_full_match(ticker, '[A-Z]{4}11') THEN 'unit' WHEN regexp_full_match(ticker, '[A-Z]{4}[345678]') THEN 'stock'
       WHEN regexp_full_match(ticker, '(WIN|IND|WDO|DOL)([FGHJKMNQUVXZ][0-9]{2})?') THEN 'future' END AS kind
  FROM u)""".replace("\\\\", "\\")


def symbols(spark, d) -> DataFrame:
    """The universe with kinds."""
    return A.universe(spark, d).withColumn("kind", K.classify(F.col("ticker")))


@query("classify", with_(UNIVERSE) + "SELECT ticker, kind, CASE WHEN kind IN ('stock', 'unit') THEN 100 ELSE 1 END AS lot_size, CASE WHEN kind = 'index' THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS tick_size FROM v")
def _(spark, d):
    return symbols(spark, d).select("ticker", "kind", K.default_lot(F.col("kind")).alias("lot_size"), K.default_tick(F.col("kind")).alias("tick_size"))


@query("search_rank", with_(UNIVERSE) + "SELECT ticker, long_name, kind FROM v WHERE strpos(ticker, 'BA') > 0 OR strpos(upper(long_name), 'BA') > 0 ORDER BY (strpos(ticker, 'BA') = 1) DESC, (strpos(ticker, 'BA') > 0) DESC, tracked DESC, active DESC, ticker LIMIT 20")
def _(spark, d):
    return universe.search(symbols(spark, d), "ba").select("ticker", "long_name", "kind")


@query("search_kind", with_(UNIVERSE) + "SELECT ticker FROM v WHERE kind = 'unit' ORDER BY tracked DESC, active DESC, ticker LIMIT 30")
def _(spark, d):
    return universe.search(symbols(spark, d), "", "unit", 30).select("ticker")


@query("symbol_lookup", with_(UNIVERSE) + "SELECT ticker, id, kind FROM v WHERE ticker = (SELECT min(ticker) FROM v WHERE id = 7)")
def _(spark, d):
    s = symbols(spark, d)
    return universe.symbol_of(s, s.where("id = 7").agg(F.lower(F.min("ticker"))).first()[0]).select("ticker", "id", "kind")


@query("symbol_listing", with_(UNIVERSE) + "SELECT ticker, id FROM v")
def _(spark, d):
    return universe.listing(symbols(spark, d)).select("ticker", "id")


@query("tracked_listing", with_(UNIVERSE) + "SELECT ticker, id FROM v WHERE tracked")
def _(spark, d):
    return universe.listing(symbols(spark, d), tracked=True).select("ticker", "id")


@query("job_symbols", with_(UNIVERSE) + "SELECT ticker, kind FROM v WHERE tracked AND kind <> 'future'")
def _(spark, d):
    return universe.resolve(symbols(spark, d)).select("ticker", "kind")


@query("enrichable", with_(UNIVERSE) + "SELECT ticker FROM v WHERE coalesce(kind, '') <> 'future' AND (ticker IN ('ITUB4', 'MGLU3', 'PETR4', 'VALE3') OR id % 2 = 0)")
def _(spark, d):
    s = symbols(spark, d)
    return universe.enrichable(s, False).unionByName(universe.enrichable(s.where("id % 2 = 0"), True)).select("ticker").distinct()


@query("candles_of_ticker", BASE.rstrip() + ", n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS symbol_id FROM (SELECT DISTINCT symbol FROM t)) SELECT symbol, symbol_id, ts, open, high, low, close, volume FROM c JOIN n USING (symbol) WHERE symbol = 'view'")
def _(spark, d):
    names = A.ticks(spark, d).select("symbol").distinct().withColumn("id", F.row_number().over(Window.orderBy("symbol")).cast("long"))
    stored = base(spark, d).join(F.broadcast(names), "symbol").select(F.col("id").alias("symbol_id"), "ts", "open", "high", "low", "close", "volume")
    upper = names.withColumn("ticker", F.upper("symbol")).drop("symbol")
    return universe.candles_of(stored, upper, "view").withColumn("symbol", F.lower("symbol")).select("symbol", "symbol_id", "ts", "open", "high", "low", "close", "volume")


@query("display_name", with_(UNIVERSE) + "SELECT ticker, coalesce(nullif(trim(long_name), ''), CASE WHEN trim(short_name) <> '' AND lower(trim(short_name)) <> lower(ticker) THEN trim(short_name) END, ticker) AS display FROM v")
def _(spark, d):
    return symbols(spark, d).select("ticker", K.display_name(F.col("ticker"), F.col("short_name"), F.col("long_name")).alias("display"))


def lists(spark, d) -> DataFrame:
    """Three index compositions over time, by symbol id."""
    s = A.universe(spark, d)
    rows = s.select("ticker", F.element_at(F.array(F.lit("ibov"), F.lit("ifix"), F.lit("smll")), (F.col("id") % 3 + 1).cast("int")).alias("index"), F.lit(2024).alias("year"), (F.col("id") % 4 + 1).cast("int").alias("month"))
    return rows.groupBy("index", "year", "month").agg(F.sort_array(F.collect_list("ticker")).alias("tickers"))


MEMBERS = "m AS (SELECT ticker, (['ibov', 'ifix', 'smll'])[id % 3 + 1] AS idx, id % 4 + 1 AS mon FROM v)"


@query("newest_per_index", with_(UNIVERSE, MEMBERS) + "SELECT idx AS \"index\", CAST(mon AS INTEGER) AS month, count(*) AS tickers FROM m WHERE (idx, mon) IN (SELECT (idx, max(mon)) FROM m GROUP BY idx) GROUP BY ALL")
def _(spark, d):
    return universe.newest_lists(lists(spark, d)).select("index", "month", F.size("tickers").cast("long").alias("tickers"))


@query("union_tickers", with_(UNIVERSE) + "SELECT DISTINCT ticker FROM v")
def _(spark, d):
    return universe.union_tickers(lists(spark, d))


def planned(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Admission lists, existing symbols and desired ones."""
    s = symbols(spark, d).where("kind IS NOT NULL")
    admitted, existing = s.where("id % 3 <> 0").select("ticker"), s.where("id % 4 <> 0").select("ticker", "kind", "active", "tracked")
    return admitted, existing, universe.desired(admitted, *contracts_of(spark))


def contracts_of(spark) -> tuple[DataFrame, DataFrame]:
    """Futures and seeds."""
    futures = spark.createDataFrame([("WIN", "Mini", "Mini contract", 0.2, 5.0, 1), ("DOL", "Dollar", "Dollar contract", 50.0, 0.5, 1)], "root string, name string, long_name string, point_value double, tick_size double, lot_size int")
    seeds = spark.createDataFrame([("^BVSP", "index", "IDX", "Index", "", None, 1.0, None, True), ("WIN", "", "", "Mini index", "", None, None, None, False)], "ticker string, kind string, short_name string, long_name string, currency string, lot_size int, tick_size double, point_value double, tracked boolean")
    return futures, seeds


PLAN = with_(UNIVERSE, """a AS (SELECT ticker, kind FROM v WHERE kind IS NOT NULL AND id % 3 <> 0),
x AS (SELECT ticker, kind, active, tracked FROM v WHERE kind IS NOT NULL AND id % 4 <> 0),
w AS (
  SELECT ticker, kind, CASE WHEN kind IN ('stock', 'unit') THEN 100 ELSE 1 END AS lot_size, CASE WHEN kind = 'index' THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS tick_size, true AS tracked, NULL::VARCHAR AS long_name FROM a
  UNION ALL SELECT 'WIN', 'future', 1, 5.0, false, 'Mini index' UNION ALL SELECT 'DOL', 'future', 1, 0.5, false, 'Dollar contract' UNION ALL SELECT '^BVSP', 'index', 1, 1.0, true, 'Index')""")


@query("admission_plan", PLAN + "SELECT w.*, x.ticker IS NULL AS created, w.tracked AND NOT coalesce(x.tracked, false) AS admitted FROM w LEFT JOIN x USING (ticker)")
def _(spark, d):
    _, existing, desired = planned(spark, d)
    return universe.admission(desired, existing).select("ticker", "kind", "lot_size", "tick_size", "tracked", "long_name", "created", "admitted")


def synced(spark, d) -> tuple[DataFrame, DataFrame]:
    """The universe after a sync against lists, contracts and a provider that lists four fifths of it."""
    s = symbols(spark, d).where("kind IS NOT NULL")
    admitted, _existing, _desired = planned(spark, d)
    null = lambda t: F.lit(None).cast(t)
    stored = s.where("id % 4 <> 0").select(
        F.col("id").cast("long").alias("id"), "ticker", "short_name", "long_name", "kind", F.lit("BRL").alias("currency"), K.default_lot(F.col("kind")).alias("lot_size"), K.default_tick(F.col("kind")).alias("tick_size"), null("double").alias("point_value"),
        "active", "tracked", F.lit("2024-01-05").cast("date").alias("first_seen"), F.lit("2024-01-05").cast("date").alias("last_seen"),
    )
    return universe.sync(stored, admitted, *contracts_of(spark), "2024-02-01", available=symbols(spark, d).where("id % 5 <> 0"))


@query("symbol_sync", PLAN + "SELECT coalesce(w.ticker, x.ticker) AS ticker, w.ticker IS NOT NULL AND x.ticker IS NULL AS created, w.ticker IS NOT NULL AND w.tracked AND NOT coalesce(x.tracked, false) AS admitted, coalesce(x.tracked, false) AND x.ticker NOT IN (SELECT ticker FROM a) AND x.ticker NOT IN (SELECT ticker FROM w WHERE tracked) AS departed, x.ticker IS NOT NULL AND x.active AND x.kind <> 'future' AND x.ticker NOT IN (SELECT ticker FROM v WHERE id % 5 <> 0) AND (w.ticker IS NOT NULL OR x.active) AS deactivated FROM w FULL JOIN x ON x.ticker = w.ticker WHERE w.ticker IS NOT NULL OR (x.tracked AND x.ticker NOT IN (SELECT ticker FROM a) AND x.ticker NOT IN (SELECT ticker FROM w WHERE tracked)) OR (x.active AND x.kind <> 'future' AND x.ticker NOT IN (SELECT ticker FROM v WHERE id % 5 <> 0))")
def _(spark, d):
    return synced(spark, d)[1]


@query("symbols_after_sync", PLAN + "SELECT coalesce(w.ticker, x.ticker) AS ticker, coalesce(w.kind, x.kind) AS kind, coalesce(w.tracked, false) OR coalesce(x.tracked, false) AS tracked, (w.ticker IS NOT NULL OR x.active) AND NOT (x.ticker IS NOT NULL AND x.active AND x.kind <> 'future' AND x.ticker NOT IN (SELECT ticker FROM v WHERE id % 5 <> 0)) AS active FROM w FULL JOIN x ON x.ticker = w.ticker")
def _(spark, d):
    return synced(spark, d)[0].select("ticker", "kind", "tracked", "active")


@query("sync_report", PLAN + "SELECT CAST(count_if(x.ticker IS NULL) AS BIGINT) AS created, array_to_string((list(w.ticker ORDER BY w.ticker) FILTER (WHERE x.ticker IS NULL))[1:20], ' ') AS created_tickers, CAST(count_if(w.tracked AND NOT coalesce(x.tracked, false)) AS BIGINT) AS admitted FROM w LEFT JOIN x USING (ticker)")
def _(spark, d):
    return universe.sync_report(synced(spark, d)[1]).select("created", F.array_join("created_tickers", " ").alias("created_tickers"), "admitted")


@query("departures", PLAN + "SELECT ticker FROM x WHERE tracked AND ticker NOT IN (SELECT ticker FROM a) AND ticker NOT IN (SELECT ticker FROM w WHERE tracked)")
def _(spark, d):
    admitted, existing, desired = planned(spark, d)
    return universe.departures(existing, admitted, desired)


@query("stale", with_(UNIVERSE) + "SELECT ticker FROM v WHERE active AND kind <> 'future' AND id % 5 = 0")
def _(spark, d):
    s = symbols(spark, d)
    return universe.stale(s, s.where("id % 5 <> 0"))


@query("enrich", with_(UNIVERSE) + "SELECT ticker, CASE WHEN id % 2 = 0 AND coalesce(kind, '') <> 'future' THEN 'Long ' || ticker ELSE long_name END AS long_name, short_name FROM v")
def _(spark, d):
    s = symbols(spark, d)
    quotes = s.where("id % 2 = 0").select(F.lower("ticker").alias("symbol"), F.lit(" ").alias("shortName"), F.concat(F.lit("Long "), "ticker").alias("longName"), F.lit("USD").alias("currency"))
    return universe.enrich(s.withColumn("currency", F.lit("BRL")), quotes).select("ticker", "long_name", "short_name")


@query("request_chunks", with_(UNIVERSE) + "SELECT ticker, CAST((row_number() OVER (ORDER BY ticker) - 1) // 20 AS INTEGER) AS chunk FROM v")
def _(spark, d):
    return universe.chunks(A.universe(spark, d).select("ticker"), 20)


def halves(spark, d) -> tuple[DataFrame, DataFrame]:
    """Stored candles of the first weeks, and newer ones that overlap them and come without adj_close."""
    c = fold.normalize(A.raw_bars(spark, d), A.january(spark), "5m")[0].withColumn("timeframe", F.lit("5m"))
    old, new = c.where("ts < timestamp_ntz'2024-01-20'"), c.where("ts >= timestamp_ntz'2024-01-10'")
    return old, new.withColumn("close", F.col("close") * 2).withColumn("adj_close", F.lit(None).cast("double"))


STORED = TAGGED.rstrip() + f",\nc AS (SELECT symbol, '5m' AS timeframe, {bucket('5m')} AS ts, first(price ORDER BY ts, ordinal) AS open, max(price) AS high, min(low) AS low, last(price ORDER BY ts, ordinal) AS close, last(adj ORDER BY ts, ordinal) FILTER (WHERE adj IS NOT NULL) AS adj_close, CAST(sum(vol) AS BIGINT) AS volume FROM g WHERE reject_reason IS NULL GROUP BY symbol, {bucket('5m')})\n"


@query("upsert_candles", STORED + "SELECT symbol, timeframe, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN close * 2 ELSE close END AS close, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN adj_close END AS adj_close, volume FROM c")
def _(spark, d):
    old, new = halves(spark, d)
    return upsert.upsert_candles(old, new, ("symbol", "timeframe", "ts"))


@query("upsert_symbols", with_(UNIVERSE) + "SELECT ticker, CASE WHEN id % 4 = 0 THEN 'new' ELSE long_name END AS long_name, CASE WHEN id % 3 = 0 THEN true ELSE tracked END AS tracked, CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN DATE '2024-01-01' ELSE DATE '2024-01-05' END AS first_seen, CASE WHEN id % 3 = 0 OR id % 4 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-05' END AS last_seen FROM v")
def _(spark, d):
    day = lambda x: F.lit(x).cast("date")
    s = A.universe(spark, d)
    null = F.lit(None).cast("double")
    old = s.select("ticker", "short_name", "long_name", null.alias("point_value"), "tracked", day("2024-01-05").alias("first_seen"), day("2024-01-05").alias("last_seen"))
    new = s.where("id % 3 = 0 OR id % 4 = 0").select("ticker", "short_name", F.when(F.col("id") % 4 == 0, "new").alias("long_name"), null.alias("point_value"), (F.col("id") % 3 == 0).alias("tracked"), day("2024-01-01").alias("first_seen"), day("2024-02-01").alias("last_seen"))
    return upsert.upsert_symbols(old, new).select("ticker", "long_name", "tracked", "first_seen", "last_seen")


@query("usage_daily", "SELECT CAST(ts AS DATE) AS \"day\", count(*) + CASE WHEN dayofmonth(CAST(ts AS DATE)) % 2 = 0 THEN 10 ELSE 0 END AS requests FROM events GROUP BY 1, dayofmonth(CAST(ts AS DATE))")
def _(spark, d):
    used = A.read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("requests"))
    more = used.where(F.dayofmonth("day") % 2 == 0).select("day", F.lit(10).cast("long").alias("requests"))
    return upsert.add_usage(used, more)


@query("usage_sum", "SELECT CAST(coalesce(count(*), 0) AS BIGINT) AS requests FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def _(spark, d):
    used = A.read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("requests"))
    return runs.usage_total(used, "2024-01-05", "2024-01-12")


@query("usage_range", "SELECT CAST(ts AS DATE) AS \"day\", count(*) AS requests FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' GROUP BY 1")
def _(spark, d):
    used = A.read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("requests"))
    return runs.usage_between(used, "2024-01-05", "2024-01-12")


@query("usage_quota", "SELECT count(*) AS requests, count(*) * 100.0::DOUBLE / 15000 AS quota_percent FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'")
def _(spark, d):
    used = A.read(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("requests"))
    return runs.usage_total(used, *ingest.usage_window(dt.date(2024, 1, 15)), quota=15_000)


@query("deactivate", with_(UNIVERSE) + "SELECT ticker, active AND id % 5 <> 0 AS active, active AND id % 5 = 0 AS changed FROM v")
def _(spark, d):
    s = A.universe(spark, d)
    return upsert.deactivate(s, s.where("id % 5 = 0")).select("ticker", "active", "changed")


@query("run_states", "SELECT o_custkey AS id, max(o_orderkey) AS seq, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
def _(spark, d):
    return runs.run_states(A.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status")))


@query("recent_failures", "SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND o_orderdate >= TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 25")
def _(spark, d):
    return runs.recent_failures(A.runs(spark, d), "1998-01-01 00:00:00", 25).select("id", "started_at")


@query("run_history", "SELECT o_orderkey AS id, o_orderdate AS started_at FROM orders WHERE o_custkey % 20 = 7 ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def _(spark, d):
    return runs.history(A.runs(spark, d), 7, "1d", 15).select("id", "started_at")


WINDOWS = "w AS (SELECT CAST(s AS DATE) AS w_start, least(CAST(s AS DATE) + 89, DATE '1998-12-31') AS w_end FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1998-12-31', INTERVAL 90 DAY) g(s))"


@query("chunk_windows", "WITH r AS (SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders) SELECT CAST(s AS DATE) AS w_start, least(CAST(s AS DATE) + 89, b) AS w_end FROM (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 90 DAY)) AS s, b FROM r)")
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    r = A.read(spark, d, "orders").agg(F.min(day).alias("a"), F.max(day).alias("b")).first()
    return ingest.chunk_windows(spark, r["a"], r["b"], 90)


@query("range_token", "SELECT p_partkey AS days, CASE WHEN p_partkey <= 92 THEN '3mo' WHEN p_partkey <= 183 THEN '6mo' WHEN p_partkey <= 366 THEN '1y' WHEN p_partkey <= 731 THEN '2y' WHEN p_partkey <= 1827 THEN '5y' WHEN p_partkey <= 3653 THEN '10y' ELSE 'max' END AS token FROM part")
def _(spark, d):
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("days"), K.intraday_range(F.col("p_partkey")).alias("token"))


COVERED = with_(WINDOWS, "i AS (SELECT o_custkey % 20 AS symbol_id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS b, o_orderstatus AS st FROM orders)", "q AS (SELECT DISTINCT symbol_id FROM i)")


def windows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Windows of twenty series, and runs."""
    log = A.runs(spark, d)
    return log.select("symbol_id").distinct(), ingest.chunk_windows(spark, "1995-01-01", "1998-12-31", 90)


@query("covered_windows", COVERED + "SELECT symbol_id, '1d' AS timeframe, w_start, w_end FROM q CROSS JOIN w WHERE EXISTS (SELECT 1 FROM i WHERE i.symbol_id = q.symbol_id AND st IN ('F', 'O') AND a <= w_start AND b >= w_end)")
def _(spark, d):
    ids, w = windows(spark, d)
    grid = ids.crossJoin(F.broadcast(w)).withColumn("timeframe", F.lit("1d"))
    return ingest.completed(grid, A.runs(spark, d)).select("symbol_id", "timeframe", "w_start", "w_end")


@query("backfill_plan", COVERED + "SELECT symbol_id, w_start, w_end, CASE WHEN symbol_id % 7 = 0 THEN 'skip' WHEN w_end < DATE '1998-12-01' AND EXISTS (SELECT 1 FROM i WHERE i.symbol_id = q.symbol_id AND st IN ('F', 'O') AND a <= w_start AND b >= w_end) THEN 'skip' ELSE 'fetch' END AS action FROM q CROSS JOIN w")
def _(spark, d):
    ids, w = windows(spark, d)
    names = ids.withColumn("ticker", F.concat(F.lit("ABCD"), F.col("symbol_id").cast("string")))
    clean = ids.where("symbol_id % 7 = 0").crossJoin(F.broadcast(w)).select("symbol_id", "w_start")
    return ingest.backfill_plan(names, w, clean, A.runs(spark, d), "1d", "1998-12-01").select("symbol_id", "w_start", "w_end", "action")


@query("backfill_dry_run", COVERED + "SELECT count(DISTINCT symbol_id) AS symbols, CAST(count_if(action <> 'unreachable') AS BIGINT) AS chunks, CAST(count_if(action = 'fetch') AS BIGINT) AS requests, CAST(count_if(action = 'skip') AS BIGINT) AS skipped, count(DISTINCT CASE WHEN action = 'unreachable' THEN symbol_id END) AS unreachable, true AS dry_run FROM (SELECT symbol_id, CASE WHEN symbol_id % 3 <> 0 THEN 'unreachable' WHEN symbol_id % 7 = 0 THEN 'skip' WHEN w_end < DATE '1998-12-01' AND EXISTS (SELECT 1 FROM i WHERE i.symbol_id = q.symbol_id AND st IN ('F', 'O') AND a <= w_start AND b >= w_end) THEN 'skip' ELSE 'fetch' END AS action FROM q CROSS JOIN w)")
def _(spark, d):
    ids, w = windows(spark, d)
    names = ids.withColumn("ticker", F.when(F.col("symbol_id") % 3 == 0, "PETR4").otherwise("XXXX3"))
    clean = ids.where("symbol_id % 7 = 0").crossJoin(F.broadcast(w)).select("symbol_id", "w_start")
    return ingest.plan_counts(ingest.backfill_plan(names, w, clean, A.runs(spark, d), "1d", "1998-12-01", has_token=False))


@query("backfill_intraday", with_(SEEN_DAYS) + "SELECT a AS w_start, b AS w_end, '6mo' AS range, " + UTC_OF.format("CAST(a AS TIMESTAMP)") + " AS keep_from, " + UTC_OF.format("CAST(b + 1 AS TIMESTAMP)") + " AS keep_to FROM (SELECT min(dy) AS a, max(dy) AS b FROM seen)")
def _(spark, d):
    return ingest.backfill_windows(spark, "5m", *seen_span(spark, d), "2024-06-01")


@query("sync_plan", with_(UNIVERSE, SESS) + "SELECT id AS symbol_id, ticker, CASE WHEN ticker IN ('ITUB4', 'MGLU3', 'PETR4', 'VALE3') THEN 'fetch' ELSE 'unreachable' END AS action, DATE '2024-01-24' AS w_start, DATE '2024-01-30' AS w_end FROM v")
def _(spark, d):
    rows = symbols(spark, d).select(F.col("id").alias("symbol_id"), "ticker")
    return ingest.sync_plan(rows, A.january(spark), "5m", A.TODAY, has_token=False).select("symbol_id", "ticker", "action", "w_start", "w_end")


NUMBERED = TAGGED.rstrip() + f""",
n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) AS symbol_id FROM (SELECT DISTINCT symbol FROM t)),
k AS (
  SELECT n.symbol_id, count(DISTINCT CASE WHEN reject_reason IS NULL AND {bucket('5m')} >= TIMESTAMP '2024-01-24 03:00:00' AND {bucket('5m')} < TIMESTAMP '2024-01-31 03:00:00' THEN {bucket('5m')} END) AS bars,
         CAST(count_if(reject_reason IS NOT NULL) AS BIGINT) AS rejected
  FROM g JOIN n USING (symbol) GROUP BY n.symbol_id),
r AS (SELECT symbol_id, CASE WHEN symbol_id = 2 THEN 'failed' WHEN bars > 0 THEN 'ok' ELSE 'empty' END AS status, CASE WHEN symbol_id = 2 THEN 0 ELSE bars END AS bars, CASE WHEN symbol_id = 2 THEN 0 ELSE rejected END AS rejected FROM k)
"""


def synced_bars(spark, d) -> tuple[DataFrame, DataFrame]:
    """Results of a tail refresh whose second series fails, and its plan."""
    names = A.ticks(spark, d).select("symbol").distinct().withColumn("symbol_id", F.row_number().over(Window.orderBy("symbol")).cast("long"))
    plan = ingest.sync_plan(names.withColumn("ticker", F.col("symbol")), A.january(spark), "5m", A.TODAY)
    bars = A.raw_bars(spark, d).join(F.broadcast(names), "symbol").withColumn("w_start", F.lit("2024-01-24").cast("date")).drop("symbol")
    errors = spark.createDataFrame([(2, dt.date(2024, 1, 24), "answered 500", 500)], "symbol_id long, w_start date, error string, http_status int")
    return ingest.run_chunks(plan, bars, errors, A.january(spark), "5m")[2], plan


@query("sync_results", NUMBERED + "SELECT * FROM r")
def _(spark, d):
    return synced_bars(spark, d)[0].select("symbol_id", "status", "bars", "rejected")


@query("sync_counts", NUMBERED + "SELECT count(*) AS symbols, count(*) AS chunks, count(*) AS requests, CAST(0 AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS unreachable, false AS dry_run, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(count_if(status = 'empty') AS BIGINT) AS empty, CAST(count_if(status = 'failed') AS BIGINT) AS failed FROM r")
def _(spark, d):
    results, plan = synced_bars(spark, d)
    return ingest.plan_counts(plan, False, results)


@query("run_audit", NUMBERED + "SELECT symbol_id AS id, symbol_id, status, CAST(bars AS INTEGER) AS bars, CAST(rejected AS INTEGER) AS rejected, CASE WHEN symbol_id = 2 THEN 'answered 500' END AS error, CASE WHEN symbol_id = 2 THEN 500 END AS http_status, CAST(61500 AS BIGINT) AS duration_ms FROM r")
def _(spark, d):
    results, _plan = synced_bars(spark, d)
    begun = runs.opened(results, "2024-01-30 20:00:00")
    ended = runs.closed(begun, results, "2024-01-30 20:01:01.5")
    return runs.run_states(begun.unionByName(ended)).select("id", "symbol_id", "status", "bars", "rejected", "error", "http_status", "duration_ms")


@query("run_tally", "SELECT count(*) AS chunks, CAST(sum(o_orderkey % 90) AS BIGINT) AS bars, CAST(sum(o_orderkey % 4) AS BIGINT) AS rejected, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS empty, CAST(count_if(o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS failed FROM orders")
def _(spark, d):
    return ingest.tally(A.runs(spark, d))


HOURLY = with_(SESS, TICKS, PLACED, candles_sql("1h"))


@query("columnar_body", HOURLY + "SELECT symbol, array_to_string(list(CAST(epoch(ts) AS BIGINT) ORDER BY ts), ',') AS ts, array_to_string(list(volume ORDER BY ts), ',') AS v, count(*) AS n FROM c GROUP BY symbol")
def _(spark, d):
    body = read.columnar(candles(spark, d, "1h"))
    return body.select("symbol", F.array_join(F.col("ts").cast("array<string>"), ",").alias("ts"), F.array_join(F.col("v").cast("array<string>"), ",").alias("v"), F.size("ts").cast("long").alias("n"))


@query("unzip_columnar", HOURLY + "SELECT symbol, CAST(epoch(ts) AS BIGINT) AS epoch, open, high, low, close, volume FROM c")
def _(spark, d):
    return read.rows_of(read.columnar(candles(spark, d, "1h")))


@query("etag", HOURLY + "SELECT symbol, '\"' || sha256(string_agg(CAST(CAST(epoch(ts) AS BIGINT) AS VARCHAR) || ':' || CAST(volume AS VARCHAR), ',' ORDER BY ts)) || '\"' AS etag FROM c GROUP BY symbol")
def _(spark, d):
    body = read.columnar(candles(spark, d, "1h"))
    text = F.array_join(F.transform(F.arrays_zip("ts", "v"), lambda z: F.concat(z["ts"].cast("string"), F.lit(":"), z["v"].cast("string"))), ",")
    return body.select("symbol", K.etag(text).alias("etag"))


@query("pct_change", HOURLY + "SELECT symbol, ts, CASE WHEN open > 0 THEN (close - open) / open * 100 END AS change FROM c")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", B.percent_change(F.col("open"), F.col("close")).alias("change"))


@query("axis_periods", HOURLY + f"SELECT symbol, ts FROM (SELECT *, CAST({LOCAL_OF.format('ts')} AS DATE) AS dy, lag(CAST({LOCAL_OF.format('ts')} AS DATE)) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM c) WHERE before IS NULL OR before <> dy")
def _(spark, d):
    day = C.local_day(F.col("ts"))
    c = candles(spark, d, "1h").withColumn("dy", day)
    return c.withColumn("before", F.lag("dy").over(indicators.by_symbol())).where("before IS NULL OR before <> dy").select("symbol", "ts")


@query("local_stamps", HOURLY + f"SELECT symbol, ts, strftime({LOCAL_OF.format('ts')}, '%d-%m-%Y %H:%M') AS stamp FROM c")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.date_format(C.local(F.col("ts"), ZONE), "dd-MM-yyyy HH:mm").alias("stamp"))


ROWS = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
SEEN = "row_number() OVER (PARTITION BY symbol ORDER BY ts)"


@query("sma_20", HOURLY + f"SELECT symbol, ts, CASE WHEN {SEEN} >= 20 THEN round(avg(close) {ROWS.format(19)}, 6) END AS sma FROM c")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.round(indicators.sma(F.col("close"), 20), 6).alias("sma"))


@query("bollinger", HOURLY + f"SELECT symbol, ts, CASE WHEN {SEEN} >= 20 THEN round(avg(close) {ROWS.format(19)} + 2 * stddev_pop(close) {ROWS.format(19)}, 4) END AS upper FROM c")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.round(indicators.bollinger(F.col("close"))[1], 4).alias("upper"))


@query("donchian", HOURLY + f"SELECT symbol, ts, CASE WHEN {SEEN} >= 20 THEN max(high) {ROWS.format(19)} END AS upper, CASE WHEN {SEEN} >= 20 THEN min(low) {ROWS.format(19)} END AS lower FROM c")
def _(spark, d):
    hi, lo, _mid = indicators.donchian(20)
    return candles(spark, d, "1h").select("symbol", "ts", hi.alias("upper"), lo.alias("lower"))


@query("cross_signals", HOURLY + f"SELECT symbol, ts FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS a, lag(open) OVER (PARTITION BY symbol ORDER BY ts) AS b FROM c) WHERE a <= b AND close > open")
def _(spark, d):
    rule = rules.compile_rule({"op": "crosses_above", "left": "close", "right": "open"})
    return candles(spark, d, "1h").withColumn("hit", rule).where("hit").select("symbol", "ts")


@query("drawdown", HOURLY + "SELECT symbol, ts, max(close) OVER w AS peak, (max(close) OVER w - close) / max(close) OVER w AS drawdown FROM c WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return backtest.drawdown(candles(spark, d, "1h"), "close").select("symbol", "ts", "peak", "drawdown")


NUMBERED_HOURS = HOURLY.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + ",\nn AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM c)"


def ema_sql(name: str, source: str, value: str, length: int, begin: int = 1, alpha: str | None = None) -> str:
    """CTE of a recursive average over ``source(symbol, rn, value)``: from row ``begin`` on, seeded by the mean of ``length`` rows."""
    seed, alpha = begin + length - 1, alpha or f"2.0::DOUBLE / {length + 1}"
    return f"""{name} AS (
  SELECT symbol, CAST({seed} AS BIGINT) AS rn, avg({value}) AS e FROM {source} WHERE rn BETWEEN {begin} AND {seed} GROUP BY symbol HAVING count(*) = {length}
  UNION ALL SELECT x.symbol, x.rn, {name}.e + ({alpha}) * (x.{value} - {name}.e) FROM {name} JOIN {source} x ON x.symbol = {name}.symbol AND x.rn = {name}.rn + 1)"""


def rounded(c: str, digits: int = 6):
    """A column rounded for the comparison; NaN (before the first value) as null."""
    return F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), digits).alias(c)


@query("ema_20", NUMBERED_HOURS + ",\n" + ema_sql("e20", "n", "close", 20) + "\nSELECT n.symbol, n.ts, round(e, 6) AS ema FROM n LEFT JOIN e20 USING (symbol, rn)")
def _(spark, d):
    return indicators.ema(candles(spark, d, "1h"), 20).select("symbol", "ts", rounded("ema"))


STEPS = "d AS (SELECT symbol, ts, rn, greatest(close - before, 0) AS up, greatest(before - close, 0) AS down FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM n) WHERE before IS NOT NULL)"


@query("rsi_14", NUMBERED_HOURS + ",\n" + STEPS + ",\n" + ema_sql("u", "d", "up", 14, 2, "1.0::DOUBLE / 14") + ",\n" + ema_sql("w", "d", "down", 14, 2, "1.0::DOUBLE / 14") + "\nSELECT n.symbol, n.ts, round(CASE WHEN w.e = 0 THEN 100 ELSE 100 - 100 / (1 + u.e / w.e) END, 6) AS rsi FROM n LEFT JOIN u USING (symbol, rn) LEFT JOIN w USING (symbol, rn)")
def _(spark, d):
    return indicators.rsi(candles(spark, d, "1h"), 14).select("symbol", "ts", rounded("rsi"))


MACD = ",\n".join([ema_sql("f", "n", "close", 12), ema_sql("g", "n", "close", 26), "m AS (SELECT f.symbol, f.rn, f.e - g.e AS line FROM f JOIN g USING (symbol, rn))", ema_sql("z", "m", "line", 9, 26)])


@query("macd", NUMBERED_HOURS + ",\n" + MACD + "\nSELECT n.symbol, n.ts, round(line, 6) AS macd, round(z.e, 6) AS macd_signal, round(line - z.e, 6) AS macd_histogram FROM n LEFT JOIN m USING (symbol, rn) LEFT JOIN z USING (symbol, rn)")
def _(spark, d):
    return indicators.macd(candles(spark, d, "1h")).select("symbol", "ts", *map(rounded, ("macd", "macd_signal", "macd_histogram")))


SIGNALS = """x AS (SELECT *, CASE WHEN rn >= 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS sma FROM n),
y AS (SELECT *, lag(close) OVER o AS pc, lag(sma) OVER o AS ps FROM x WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
q AS (SELECT *, coalesce(pc <= ps AND close > sma, false) AS enter, coalesce(pc >= ps AND close < sma, false) AS leave FROM y),
k AS (
  SELECT symbol, rn, NULL::DOUBLE AS held, CASE WHEN leave THEN 'leave' WHEN enter THEN 'enter' END AS pending, NULL::BIGINT AS a, NULL::BIGINT AS b FROM q WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN o IS NULL THEN h END, CASE WHEN leave THEN 'leave' WHEN enter THEN 'enter' END, CASE WHEN o IS NOT NULL THEN CAST(round_even(h * 100, 0) AS BIGINT) * 100 END, CASE WHEN o IS NOT NULL THEN CAST(round_even(o * 100, 0) AS BIGINT) * 100 END
  FROM (
    SELECT *, CASE WHEN left_by_signal THEN open WHEN h IS NULL THEN NULL WHEN low <= h * (1 - 0.5::DOUBLE) THEN least(open, h * (1 - 0.5::DOUBLE)) WHEN high >= h * (1 + 1.0::DOUBLE) THEN greatest(open, h * (1 + 1.0::DOUBLE)) END AS o
    FROM (
      SELECT q.symbol, q.rn, q.open, q.high, q.low, q.enter, q.leave, CASE WHEN k.pending = 'enter' AND k.held IS NULL THEN q.open ELSE k.held END AS h, coalesce(k.pending = 'leave' AND k.held IS NOT NULL, false) AS left_by_signal
      FROM k JOIN q ON q.symbol = k.symbol AND q.rn = k.rn + 1))),
trades AS (SELECT symbol, b - a - CAST(round_even((a + b) * 3.0::DOUBLE / 1e4, 0) AS BIGINT) AS profit FROM k WHERE a IS NOT NULL)
SELECT symbol, count(*) AS trades, CAST(count_if(profit > 0) AS BIGINT) AS wins, count_if(profit > 0) / count(*) AS win_rate, CAST(sum(profit) AS BIGINT) AS profit_cents,
       CASE WHEN sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) > 0 THEN CAST(sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) AS DOUBLE) END AS profit_factor, min(profit) AS worst_cents
FROM trades GROUP BY symbol"""


@query("backtest_metrics", NUMBERED_HOURS + ",\n" + SIGNALS)
def _(spark, d):
    c = candles(spark, d, "1h").withColumn("sma", indicators.sma(F.col("close"), 5))
    up, down = ({"op": op, "left": "close", "right": "sma"} for op in ("crosses_above", "crosses_below"))
    signals = c.withColumn("enter", rules.compile_rule(up)).withColumn("leave", rules.compile_rule(down))
    return backtest.metrics(backtest.backtest(signals, stop=0.5, target=1.0, fee_bps=3))


IN_ORDER = " WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
TYPICAL = "(high + low + close) / 3"
FLOW = "(CASE WHEN high > low THEN (2 * close - low - high) / (high - low) ELSE 0 END * coalesce(volume, 0))"


@query("cci_20", HOURLY + f"SELECT symbol, ts, round(CASE WHEN rn >= 20 AND s > 0 THEN (p - m) / (s * 0.015::DOUBLE) END, 4) AS cci FROM (SELECT *, list_avg(list_transform(l, lambda x: abs(x - m))) AS s FROM (SELECT symbol, ts, {TYPICAL} AS p, {SEEN} AS rn, list({TYPICAL}) {ROWS.format(19)} AS l, avg({TYPICAL}) {ROWS.format(19)} AS m FROM c))")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.round(indicators.commodity_channel(20), 4).alias("cci"))


@query("aroon_25", HOURLY + f"SELECT symbol, ts, CASE WHEN rn >= 26 THEN round((26 - list_position(list_reverse(h), list_max(h))) * 100.0::DOUBLE / 25, 6) END AS up, CASE WHEN rn >= 26 THEN round((26 - list_position(list_reverse(l), list_min(l))) * 100.0::DOUBLE / 25, 6) END AS down FROM (SELECT symbol, ts, {SEEN} AS rn, list(high) {ROWS.format(25)} AS h, list(low) {ROWS.format(25)} AS l FROM c)")
def _(spark, d):
    up, down = indicators.aroon(25)
    return candles(spark, d, "1h").select("symbol", "ts", F.round(up, 6).alias("up"), F.round(down, 6).alias("down"))


@query("volume_flows", HOURLY + f"SELECT symbol, ts, round(sum({FLOW}) {ROWS.format('UNBOUNDED')}, 3) + 0.0 AS ad, CASE WHEN {SEEN} >= 20 AND sum(volume) {ROWS.format(19)} > 0 THEN round(sum({FLOW}) {ROWS.format(19)} / sum(volume) {ROWS.format(19)}, 6) + 0.0 END AS cmf FROM c")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.round(indicators.accumulation(), 3).alias("ad"), F.round(indicators.chaikin_flow(20), 6).alias("cmf"))


MONEY = "sum(CASE WHEN p {} b THEN p * coalesce(volume, 0) ELSE 0 END) " + ROWS.format(13)


@query("mfi_14", HOURLY + f"SELECT symbol, ts, CASE WHEN rn >= 15 AND u + d > 0 THEN round(u / (u + d) * 100, 5) END AS mfi FROM (SELECT symbol, ts, rn, {MONEY.format('>')} AS u, {MONEY.format('<')} AS d FROM (SELECT *, lag(p) OVER w AS b, row_number() OVER w AS rn FROM (SELECT *, {TYPICAL} AS p FROM c){IN_ORDER}))")
def _(spark, d):
    return indicators.money_flow(candles(spark, d, "1h"), 14).select("symbol", "ts", rounded("mfi", 5))


@query("volatility_20", HOURLY + f"SELECT symbol, ts, CASE WHEN rn >= 21 THEN round(stddev_samp(r) {ROWS.format(19)} * sqrt(252.0::DOUBLE) * 100, 4) END AS hv FROM (SELECT symbol, ts, row_number() OVER w AS rn, ln(close / lag(close) OVER w) AS r FROM c{IN_ORDER})")
def _(spark, d):
    return indicators.historical_volatility(candles(spark, d, "1h"), 20).select("symbol", "ts", rounded("hv", 4))


def wma_sql(value: str, n: int) -> str:
    """Weighted average of ``value`` over n rows of the window ``w``."""
    return "(" + " + ".join(f"coalesce(lag({value}, {i}) OVER w, 0) * {n - i}" for i in range(n)) + f") / {n * (n + 1) / 2}::DOUBLE"


@query("hma_16", HOURLY + f"SELECT symbol, ts, CASE WHEN rn >= 19 THEN round({wma_sql('h', 4)}, 6) END AS hma FROM (SELECT symbol, ts, row_number() OVER w AS rn, 2 * {wma_sql('close', 8)} - {wma_sql('close', 16)} AS h FROM c{IN_ORDER}){IN_ORDER}")
def _(spark, d):
    return indicators.hull(candles(spark, d, "1h"), 16).select("symbol", "ts", rounded("hma"))


def middle_sql(n: int) -> str:
    """Middle of the highest high and lowest low of n rows."""
    return f"CASE WHEN {SEEN} >= {n} THEN (max(high) {ROWS.format(n - 1)} + min(low) {ROWS.format(n - 1)}) / 2 END"


@query("ichimoku", HOURLY + f"SELECT symbol, ts, conversion, base, lag((conversion + base) / 2, 26) OVER w AS span_a, lag(m, 26) OVER w AS span_b, lead(close, 26) OVER w AS lagging FROM (SELECT symbol, ts, close, {middle_sql(9)} AS conversion, {middle_sql(26)} AS base, {middle_sql(52)} AS m FROM c){IN_ORDER}")
def _(spark, d):
    return indicators.ichimoku(candles(spark, d, "1h")).select("symbol", "ts", "conversion", "base", "span_a", "span_b", "lagging")


def beyond_sql(c: str, sign: str) -> str:
    """Whether ``c`` is beyond that of two rows on either side."""
    return "coalesce(" + " AND ".join(f"{c} {sign} {side}({c}, {k}) OVER w" for side in ("lag", "lead") for k in (1, 2)) + ", false)"


@query("fractals", HOURLY + f"SELECT symbol, ts, {beyond_sql('high', '>')} AS fractal_high, {beyond_sql('low', '<')} AS fractal_low FROM c{IN_ORDER}")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", *indicators.fractals(2))


@query("pivot_points", DAILY + f"SELECT symbol, ts, round(p, 6) AS pivot, round(2 * p - l, 6) AS r1, round(2 * p - h, 6) AS s1, round(p + h - l, 6) AS r2, round(p - h + l, 6) AS s2 FROM (SELECT *, (h + l + k) / 3 AS p FROM (SELECT symbol, ts, lag(high) OVER w AS h, lag(low) OVER w AS l, lag(close) OVER w AS k FROM c{IN_ORDER}))")
def _(spark, d):
    rows = candles(spark, d, "1d").select("symbol", "ts", *indicators.pivots())
    return rows.select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("pivot", "r1", "s1", "r2", "s2")])


TEMA = ",\n".join([ema_sql("e1", "n", "close", 10), ema_sql("e2", "e1", "e", 10, 10), ema_sql("e3", "e2", "e", 10, 19)])


@query("dema_tema", NUMBERED_HOURS + ",\n" + TEMA + "\nSELECT n.symbol, n.ts, round(2 * e1.e - e2.e, 6) AS dema, round(3 * e1.e - 3 * e2.e + e3.e, 6) AS tema FROM n LEFT JOIN e1 USING (symbol, rn) LEFT JOIN e2 USING (symbol, rn) LEFT JOIN e3 USING (symbol, rn)")
def _(spark, d):
    return indicators.dema_tema(candles(spark, d, "1h"), 10).select("symbol", "ts", rounded("dema"), rounded("tema"))


RANGES = "r AS (SELECT *, greatest(high - low, abs(high - before), abs(low - before)) AS t FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM n))"


@query("keltner", NUMBERED_HOURS + ",\n" + ",\n".join([RANGES, ema_sql("e20", "n", "close", 20), ema_sql("a10", "r", "t", 10, 1, "1.0::DOUBLE / 10")]) + "\nSELECT n.symbol, n.ts, round(e20.e, 6) AS middle, round(e20.e + 2 * a10.e, 6) AS upper, round(e20.e - 2 * a10.e, 6) AS lower FROM n LEFT JOIN e20 USING (symbol, rn) LEFT JOIN a10 USING (symbol, rn)")
def _(spark, d):
    return indicators.keltner(candles(spark, d, "1h")).select("symbol", "ts", *map(rounded, ("middle", "upper", "lower")))


RSI = "x AS (SELECT n.symbol, n.ts, n.rn, CASE WHEN w.e = 0 THEN 100 ELSE 100 - 100 / (1 + u.e / w.e) END AS r FROM n LEFT JOIN u USING (symbol, rn) LEFT JOIN w USING (symbol, rn))"


@query("stoch_rsi_14", NUMBERED_HOURS + ",\n" + ",\n".join([STEPS, ema_sql("u", "d", "up", 14, 2, "1.0::DOUBLE / 14"), ema_sql("w", "d", "down", 14, 2, "1.0::DOUBLE / 14"), RSI]) + f"\nSELECT symbol, ts, CASE WHEN k = 14 AND h > l THEN round((r - l) / (h - l) * 100, 4) END AS stoch_rsi FROM (SELECT symbol, ts, r, count(r) {ROWS.format(13)} AS k, max(r) {ROWS.format(13)} AS h, min(r) {ROWS.format(13)} AS l FROM x)")
def _(spark, d):
    return indicators.stochastic_rsi(candles(spark, d, "1h"), 14).select("symbol", "ts", rounded("stoch_rsi", 4))


MOVES = "v AS (SELECT symbol, ts, rn, t, CASE WHEN u > d AND u > 0 THEN u ELSE 0 END AS plus, CASE WHEN d > u AND d > 0 THEN d ELSE 0 END AS minus FROM (SELECT *, high - lag(high) OVER w AS u, lag(low) OVER w - low AS d FROM r" + IN_ORDER + ") WHERE u IS NOT NULL)"
LINES = """x AS (SELECT symbol, rn, CASE WHEN va.e > 0 THEN vp.e / va.e * 100 ELSE 0 END AS plus_di, CASE WHEN va.e > 0 THEN vm.e / va.e * 100 ELSE 0 END AS minus_di
  FROM va JOIN vp USING (symbol, rn) JOIN vm USING (symbol, rn)),
y AS (SELECT *, CASE WHEN plus_di + minus_di > 0 THEN abs(plus_di - minus_di) / (plus_di + minus_di) * 100 ELSE 0 END AS apart FROM x)"""
WILDER = [ema_sql(name, "v", value, 14, 2, "1.0::DOUBLE / 14") for name, value in (("va", "t"), ("vp", "plus"), ("vm", "minus"))]
ADX = ",\n".join([RANGES, MOVES, *WILDER, LINES, ema_sql("z", "y", "apart", 14, 15, "1.0::DOUBLE / 14")])


@query("adx_14", NUMBERED_HOURS + ",\n" + ADX + "\nSELECT n.symbol, n.ts, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di, round(z.e, 4) AS adx FROM n LEFT JOIN y USING (symbol, rn) LEFT JOIN z USING (symbol, rn)")
def _(spark, d):
    return indicators.directional(candles(spark, d, "1h"), 14).select("symbol", "ts", *[rounded(c, 4) for c in ("plus_di", "minus_di", "adx")])


PSAR = """k AS (
  SELECT symbol, ts, rn, NULL::BOOLEAN AS up, NULL::DOUBLE AS sar, NULL::DOUBLE AS ep, NULL::DOUBLE AS af, high AS h1, low AS l1, high AS h2, low AS l2, close AS pc FROM n WHERE rn = 1
  UNION ALL
  SELECT symbol, ts, rn, CASE WHEN up IS NULL THEN NOT close < pc WHEN flip THEN NOT up ELSE up END,
         CASE WHEN up IS NULL THEN CASE WHEN close < pc THEN h1 ELSE l1 END WHEN NOT flip THEN stop WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
         CASE WHEN up IS NULL THEN CASE WHEN close < pc THEN least(l1, low) ELSE greatest(h1, high) END WHEN flip THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(ep, high) ELSE least(ep, low) END,
         CASE WHEN up IS NULL OR flip THEN 0.02::DOUBLE WHEN CASE WHEN up THEN high > ep ELSE low < ep END THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END,
         high, low, h1, l1, close
  FROM (SELECT *, CASE WHEN up THEN low < stop ELSE high > stop END AS flip
        FROM (SELECT n.symbol, n.ts, n.rn, n.high, n.low, n.close, k.up, k.ep, k.af, k.h1, k.l1, k.pc, CASE WHEN k.up THEN least(k.sar + k.af * (k.ep - k.sar), k.l1, k.l2) ELSE greatest(k.sar + k.af * (k.ep - k.sar), k.h1, k.h2) END AS stop
              FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1)))"""


@query("parabolic_sar", NUMBERED_HOURS + ",\n" + PSAR + "\nSELECT symbol, ts, round(sar, 6) AS psar, up AS psar_up FROM k")
def _(spark, d):
    return indicators.parabolic(candles(spark, d, "1h")).select("symbol", "ts", rounded("psar"), "psar_up")


BANDS = "b AS (SELECT r.symbol, r.ts, r.rn, r.close, (high + low) / 2 + 2.0::DOUBLE * a.e AS over, (high + low) / 2 - 2.0::DOUBLE * a.e AS under, close >= (high + low) / 2 AS up FROM r JOIN a USING (symbol, rn))"
SUPERTREND = """k AS (
  SELECT symbol, ts, rn, over AS upper, under AS lower, up, close FROM b WHERE rn = 7
  UNION ALL
  SELECT symbol, ts, rn, upper, lower, CASE WHEN up THEN NOT close < lower ELSE close > upper END, close
  FROM (SELECT b.symbol, b.ts, b.rn, b.close, k.up, CASE WHEN b.over < k.upper OR k.close > k.upper THEN b.over ELSE k.upper END AS upper, CASE WHEN b.under > k.lower OR k.close < k.lower THEN b.under ELSE k.lower END AS lower
        FROM k JOIN b ON b.symbol = k.symbol AND b.rn = k.rn + 1))"""


@query("supertrend", NUMBERED_HOURS + ",\n" + ",\n".join([RANGES, ema_sql("a", "r", "t", 7, 1, "1.0::DOUBLE / 7"), BANDS, SUPERTREND]) + "\nSELECT n.symbol, n.ts, round(CASE WHEN up THEN lower ELSE upper END, 6) AS supertrend, up AS supertrend_up FROM n LEFT JOIN k USING (symbol, rn)")
def _(spark, d):
    return indicators.supertrend(candles(spark, d, "1h"), 7, 2.0).select("symbol", "ts", rounded("supertrend"), "supertrend_up")


ZIGZAG = """k AS (
  SELECT symbol, ts, rn, 0 AS side, high AS ext, ts AS ext_ts, low, ts AS low_ts, NULL::DOUBLE AS turned, NULL::TIMESTAMP AS turned_ts FROM n WHERE rn = 1
  UNION ALL
  SELECT symbol, ts, rn, CASE turn WHEN 'rise' THEN 1 WHEN 'fall' THEN -1 ELSE side END,
         CASE WHEN turn = 'rise' OR turn = 'higher' OR turn IS NULL AND side = 0 AND h > ext THEN h WHEN turn = 'fall' OR turn = 'lower' THEN l ELSE ext END,
         CASE WHEN turn IS NOT NULL OR side = 0 AND h > ext THEN ts ELSE ext_ts END,
         CASE WHEN turn IS NULL AND side = 0 THEN least(l, low) END, CASE WHEN turn IS NULL AND side = 0 THEN CASE WHEN l < low THEN ts ELSE low_ts END END,
         CASE WHEN turn = 'rise' AND side = 0 THEN low WHEN turn IN ('rise', 'fall') THEN ext END, CASE WHEN turn = 'rise' AND side = 0 THEN low_ts WHEN turn IN ('rise', 'fall') THEN ext_ts END
  FROM (SELECT n.symbol, n.ts, n.rn, n.high AS h, n.low AS l, k.side, k.ext, k.ext_ts, k.low, k.low_ts,
               CASE k.side WHEN 0 THEN CASE WHEN n.high >= k.low * (1 + 0.6::DOUBLE) THEN 'rise' WHEN n.low <= k.ext * (1 - 0.6::DOUBLE) THEN 'fall' END
                           WHEN 1 THEN CASE WHEN n.high > k.ext THEN 'higher' WHEN n.low <= k.ext * (1 - 0.6::DOUBLE) THEN 'fall' END
                           ELSE CASE WHEN n.low < k.ext THEN 'lower' WHEN n.high >= k.ext * (1 + 0.6::DOUBLE) THEN 'rise' END END AS turn
        FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1))"""
PIVOTS = """SELECT symbol, CASE WHEN side = 1 THEN 'low' ELSE 'high' END AS kind, turned_ts AS ts, turned AS price, ts AS confirmed_ts, false AS open FROM k WHERE turned IS NOT NULL
UNION ALL SELECT symbol, CASE WHEN side = 1 THEN 'high' ELSE 'low' END, ext_ts, ext, NULL, true FROM k WHERE side <> 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1"""


@query("zigzag", NUMBERED_HOURS + ",\n" + ZIGZAG + "\n" + PIVOTS)
def _(spark, d):
    return indicators.zigzag(candles(spark, d, "1h"), 0.6)


RETURNS = f"""SELECT symbol, steps, round(b / a - 1, 6) AS total_return, round(CASE WHEN steps > 0 THEN pow(b / a, 252.0::DOUBLE / steps) - 1 END, 4) AS cagr, round(dev * sqrt(252.0::DOUBLE), 6) AS volatility, round(most, 6) AS max_drawdown,
       round(CASE WHEN dev > 0 THEN mean / dev * sqrt(252.0::DOUBLE) END, 6) AS sharpe, round(CASE WHEN down > 0 THEN mean / down * sqrt(252.0::DOUBLE) END, 6) AS sortino, round(CASE WHEN most > 0 AND steps > 0 THEN (pow(b / a, 252.0::DOUBLE / steps) - 1) / most END, 4) AS calmar
FROM (SELECT symbol, count(step) AS steps, arg_min(close, ts) AS a, arg_max(close, ts) AS b, avg(step) AS mean, stddev_samp(step) AS dev, sqrt(avg(pow(CASE WHEN step < 0 THEN step WHEN step >= 0 THEN 0 END, 2))) AS down, max(fallen) AS most
      FROM (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS step, (max(close) OVER w - close) / max(close) OVER w AS fallen FROM c{IN_ORDER}) GROUP BY symbol)"""


@query("return_metrics", HOURLY + RETURNS)
def _(spark, d):
    rows = backtest.return_metrics(candles(spark, d, "1h"), "close")
    digits = {"total_return": 6, "cagr": 4, "volatility": 6, "max_drawdown": 6, "sharpe": 6, "sortino": 6, "calmar": 4}
    return rows.select("symbol", "steps", *[F.round(c, n).alias(c) for c, n in digits.items()])


FUTURES = """WITH o AS (SELECT substring(o_orderpriority, 3, 30) AS root, CAST(date_trunc('month', o_orderdate) AS DATE) AS dy, o_orderkey, o_totalprice, o_custkey, year(o_orderdate) * 2 + CASE WHEN month(o_orderdate) > 6 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 5 < month(o_orderdate) % 6 THEN 1 ELSE 0 END AS half FROM orders),
b AS (SELECT root, last_day(make_date(half // 2, CASE WHEN half % 2 = 0 THEN 6 ELSE 12 END, 1)) AS expiry, dy, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(sum(o_custkey % 50) AS BIGINT) AS volume FROM o GROUP BY ALL),
lead AS (SELECT root, dy, expiry FROM b QUALIFY row_number() OVER (PARTITION BY root, dy ORDER BY volume DESC, expiry) = 1),
front AS (SELECT root, dy, max(expiry) OVER (PARTITION BY root ORDER BY dy) AS expiry FROM lead),
turn AS (SELECT * FROM (SELECT *, lag(expiry) OVER (PARTITION BY root ORDER BY dy) AS was FROM front) WHERE was <> expiry),
roll AS (SELECT t.root, t.dy, t.was, t.expiry, max(x.dy) AS common, arg_max(y.close / x.close, x.dy) AS ratio, arg_max(y.close - x.close, x.dy) AS difference
         FROM turn t LEFT JOIN (b x JOIN b y ON x.root = y.root AND x.dy = y.dy) ON x.root = t.root AND x.expiry = t.was AND y.expiry = t.expiry AND x.dy < t.dy GROUP BY ALL),
s AS (SELECT b.*, coalesce((SELECT product(ratio) FROM roll r WHERE r.root = b.root AND r.dy > b.dy), 1) AS factor, coalesce((SELECT sum(difference) FROM roll r WHERE r.root = b.root AND r.dy > b.dy), 0) AS shift FROM b JOIN front f USING (root, dy, expiry))
"""
NAME = "root || '-' || strftime({}, '%Y%m')"


@query("roll_calendar", FUTURES + f"SELECT root, dy, {NAME.format('was')} AS from_contract, {NAME.format('expiry')} AS contract, CAST(common AS TIMESTAMP) AS common_ts, round(ratio, 9) AS ratio, round(difference, 4) AS difference FROM roll")
def _(spark, d):
    bars = A.contracts(spark, d)
    return futures.rolls(bars, futures.by_volume(bars)).withColumns({"ratio": F.round("ratio", 9), "difference": F.round("difference", 4)})


def adjusted(how: str):
    """A continuous series of the contracts, rounded."""

    def run(spark, d):
        bars = A.contracts(spark, d)
        front = futures.by_volume(bars)
        rows = futures.continuous(bars, front, futures.rolls(bars, front), how)
        return rows.select("root", "ts", "contract", *[F.round(c, 4).alias(c) for c in futures.PRICES], "volume")

    return run


SERIES = f"SELECT root, CAST(dy AS TIMESTAMP) AS ts, {NAME.format('expiry')} AS contract, " + ", ".join(f"round({c} * {{0}} + {{1}}, 4) AS {c}" for c in futures.PRICES) + ", volume FROM s"
query("continuous_ratio", FUTURES + SERIES.format("factor", "0"))(adjusted("ratio"))
query("continuous_difference", FUTURES + SERIES.format("1", "shift"))(adjusted("difference"))


def positions_sql(keys: str, stop: float, target: float, slip: float = 0.0, tick: float | None = None) -> str:
    """CTE k of the position after each bar of q(keys, rn, ts, open, high, low, close, enter, leave), rn from 1 within the keys: ``o`` is
    the price that closes the position of price ``h``; prices are in ticks where there is a tick."""
    d = lambda v: f"{v!r}::DOUBLE"
    per = f" / {d(tick)}" if tick else ""
    buy = f"ceil(q.open * {d(1 + slip / 1e4)}{per} - 1e-9)" if tick else f"q.open * {d(1 + slip / 1e4)}"
    sell = lambda p: f"floor({p}{per} + 1e-9)" if tick else p
    floor, roof = (f"floor(h * (1 - {d(stop)}) + 1e-9)", f"ceil(h * (1 + {d(target)}) - 1e-9)") if tick else (f"h * (1 - {d(stop)})", f"h * (1 + {d(target)})")
    slack = "1e-9" if tick else "0"
    low, high = f"low{per} <= fl + {slack}", f"high{per} >= rf - {slack}"
    same = " AND ".join(f"q.{c} = k.{c}" for c in keys.split(", "))
    mine = ", ".join(f"q.{c}" for c in keys.split(", "))
    pend = "CASE WHEN leave THEN 'leave' WHEN enter THEN 'enter' END"
    return f"""k AS (
  SELECT {keys}, rn, ts, close, {pend} AS pend, NULL::DOUBLE AS held, NULL::TIMESTAMP AS since, NULL::DOUBLE AS h, NULL::TIMESTAMP AS entered, NULL::DOUBLE AS o, NULL::VARCHAR AS reason, false AS unsure FROM q WHERE rn = 1
  UNION ALL
  SELECT {keys}, rn, ts, close, pend, CASE WHEN o IS NULL THEN h END, CASE WHEN o IS NULL THEN entered END, h, entered, o, reason, coalesce(NOT lv AND {low} AND {high}, false)
  FROM (SELECT *, CASE WHEN lv THEN {sell(f"open * {d(1 - slip / 1e4)}" if slip else "open")} WHEN {low} THEN least({sell("open")}, fl) WHEN {high} THEN greatest({sell("open")}, rf) END AS o, CASE WHEN lv THEN 'signal' WHEN {low} THEN 'stop' WHEN {high} THEN 'target' END AS reason
        FROM (SELECT *, {floor} AS fl, {roof} AS rf
              FROM (SELECT {mine}, q.rn, q.ts, q.open, q.high, q.low, q.close, CASE WHEN q.leave THEN 'leave' WHEN q.enter THEN 'enter' END AS pend, CASE WHEN k.pend = 'enter' AND k.held IS NULL THEN {buy} ELSE k.held END AS h,
                           CASE WHEN k.pend = 'enter' AND k.held IS NULL THEN q.ts ELSE k.since END AS entered, coalesce(k.pend = 'leave' AND k.held IS NOT NULL, false) AS lv
                    FROM k JOIN q ON {same} AND q.rn = k.rn + 1))))"""


def crossing_sql(length: int) -> str:
    """Hours with the signals of a close crossing its average of ``length`` hours."""
    mean = f"CASE WHEN rn >= {length} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) END"
    return f"SELECT *, coalesce(pc <= ps AND close > sma, false) AS enter, coalesce(pc >= ps AND close < sma, false) AS leave FROM (SELECT *, lag(close) OVER o AS pc, lag(sma) OVER o AS ps FROM (SELECT *, {mean} AS sma FROM n) WINDOW o AS (PARTITION BY symbol ORDER BY ts))"


def crossing(rows, length):
    """Rows with enter and leave where the close crosses its average of ``length`` bars."""
    c = rows.withColumn("sma", indicators.sma(F.col("close"), length))
    up, down = ({"op": op, "left": "close", "right": "sma"} for op in ("crosses_above", "crosses_below"))
    return c.withColumn("enter", rules.compile_rule(up)).withColumn("leave", rules.compile_rule(down))


IN_TICKS = """, m AS (SELECT symbol, entered AS entry_ts, ts AS exit_ts, reason, unsure AS ambiguous, CAST(round_even(h * 2.5::DOUBLE, 0) AS BIGINT) * 100 AS entry_cents, CAST(round_even(o * 2.5::DOUBLE, 0) AS BIGINT) * 100 AS exit_cents FROM k WHERE o IS NOT NULL)
SELECT *, exit_cents - entry_cents AS profit_cents FROM m"""


@query("backtest_ticks", NUMBERED_HOURS + ",\nq AS (" + crossing_sql(5) + "),\n" + positions_sql("symbol", 0.3, 0.4, 7.0, 0.025) + IN_TICKS)
def _(spark, d):
    trades = backtest.backtest(crossing(candles(spark, d, "1h"), 5), stop=0.3, target=0.4, slippage_bps=7.0, tick=0.025)
    return trades.select("symbol", "entry_ts", "exit_ts", "reason", "ambiguous", "entry_cents", "exit_cents", "profit_cents")


SWEPT = ",\nx AS (SELECT 3 AS run_id, * FROM (" + crossing_sql(3) + ") UNION ALL SELECT 8, * FROM (" + crossing_sql(8) + "))"
CENTS = "CAST(round_even(h * 100, 0) AS BIGINT) * 100 AS a, CAST(round_even(o * 100, 0) AS BIGINT) * 100 AS b"
FEES = "CAST(round_even((a + b) * 3.0::DOUBLE / 1e4, 0) AS BIGINT)"


@query("sweep", NUMBERED_HOURS + SWEPT + ",\nq AS (SELECT * FROM x),\n" + positions_sql("symbol, run_id", 0.5, 1.0) + f"\nSELECT symbol, run_id, count(*) AS trades, CAST(sum(b - a - {FEES}) AS BIGINT) AS profit_cents FROM (SELECT symbol, run_id, {CENTS} FROM k WHERE o IS NOT NULL) GROUP BY ALL")
def _(spark, d):
    trades = backtest.sweep(candles(spark, d, "1h"), spark.createDataFrame([(3,), (8,)], "run_id int"), crossings, stop=0.5, target=1.0, fee_bps=3)
    return trades.groupBy("symbol", "run_id").agg(F.count("*").alias("trades"), F.sum("profit_cents").alias("profit_cents"))


def crossings(rows):
    """Signals of averages of ``run_id`` bars, of the two lengths that are tried."""
    a, b = crossing(rows, 3), crossing(rows, 8)
    return a.where("run_id = 3").unionByName(b.where("run_id = 8"))


FORWARD = f""",
days AS (SELECT dy, row_number() OVER (ORDER BY dy) - 1 AS d, count(*) OVER () AS total FROM (SELECT DISTINCT CAST(ts AS DATE) AS dy FROM n)),
wins AS (SELECT dy, w, CASE WHEN d < w * 3 + 5 THEN 'train' ELSE 'test' END AS role FROM days, generate_series(0, 30) g(w) WHERE w * 3 + 5 < total AND d BETWEEN w * 3 AND w * 3 + 7),
q AS (SELECT symbol, run_id, w, role, row_number() OVER (PARTITION BY symbol, run_id, w, role ORDER BY ts) AS rn, ts, open, high, low, close, enter, leave FROM x JOIN wins ON CAST(ts AS DATE) = dy),
{positions_sql("symbol, run_id, w, role", 0.5, 1.0)},
sold AS (SELECT symbol, run_id, w, role, ts, entered, h, o, reason FROM k WHERE o IS NOT NULL
  UNION ALL SELECT symbol, run_id, w, role, ts, since, held, close, 'end' FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY symbol, run_id, w, role ORDER BY rn DESC) = 1) WHERE held IS NOT NULL),
m AS (SELECT *, b - a - {FEES} AS profit FROM (SELECT *, {CENTS} FROM sold)),
best AS (SELECT symbol, w, run_id, profit FROM (SELECT q.symbol, q.w, q.run_id, coalesce((SELECT sum(profit) FROM m WHERE m.symbol = q.symbol AND m.w = q.w AND m.run_id = q.run_id AND m.role = 'train'), 0) AS profit FROM (SELECT DISTINCT symbol, w, run_id FROM q WHERE role = 'train') q)
  QUALIFY row_number() OVER (PARTITION BY symbol, w ORDER BY profit DESC, run_id) = 1)
SELECT m.symbol, CAST(m.w AS INTEGER) AS "window", m.run_id, CAST(best.profit AS BIGINT) AS train_cents, m.entered AS entry_ts, m.ts AS exit_ts, m.reason, m.profit AS profit_cents,
       CAST(sum(m.profit) OVER (PARTITION BY m.symbol ORDER BY m.ts, m.entered ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS equity_cents
FROM m JOIN best USING (symbol, w, run_id) WHERE m.role = 'test'"""


@query("walk_forward", NUMBERED_HOURS + SWEPT + FORWARD)
def _(spark, d):
    rows = backtest.walk_forward(candles(spark, d, "1h"), spark.createDataFrame([(3,), (8,)], "run_id int"), crossings, 5, 3, stop=0.5, target=1.0, fee_bps=3)
    return rows.select("symbol", "window", "run_id", "train_cents", "entry_ts", "exit_ts", "reason", "profit_cents", "equity_cents")


PORTFOLIO = """WITH RECURSIVE o AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS c, day(o_orderdate) <= 20 AS early FROM orders),
b AS (SELECT symbol, ts, CAST(sum(c) // count(c) AS DOUBLE) / 100 AS open, CAST(coalesce(sum(c) FILTER (early) // count(c) FILTER (early), sum(c) // count(c)) AS DOUBLE) / 100 AS close FROM o GROUP BY ALL),
s AS (SELECT symbol, ts, open, lag(score) OVER (PARTITION BY symbol ORDER BY ts) AS score FROM (SELECT *, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY ts) AS score FROM b)),
c AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC NULLS LAST, symbol) <= 2 AND score IS NOT NULL AS chosen FROM s),
w AS (SELECT ts, symbol, CAST(round_even(open * 100, 0) AS BIGINT) AS cents, CASE WHEN chosen THEN 1 / count_if(chosen) OVER (PARTITION BY ts) ELSE 0 END AS weight FROM c),
d AS (SELECT ts, row_number() OVER (ORDER BY ts) AS i FROM (SELECT DISTINCT ts FROM w)),
u AS (SELECT d.i, d.ts, y.symbol, w.cents, w.weight FROM d CROSS JOIN (SELECT DISTINCT symbol FROM w) y LEFT JOIN w ON w.ts = d.ts AND w.symbol = y.symbol),
k AS (
  SELECT CAST(0 AS BIGINT) AS i, NULL::TIMESTAMP AS ts, symbol, CAST(0 AS BIGINT) AS quantity, CAST(0 AS BIGINT) AS cents, CAST(5000000000 AS BIGINT) AS cash, CAST(5000000000 AS BIGINT) AS equity, CAST(0 AS BIGINT) AS fees, CAST(0 AS BIGINT) AS traded FROM (SELECT DISTINCT symbol FROM w)
  UNION ALL
  SELECT i, ts, symbol, goal, price, CAST(cash - sum(step * price) OVER () - sum(fee) OVER () AS BIGINT), CAST(worth - sum(fee) OVER () AS BIGINT), CAST(sum(fee) OVER () AS BIGINT), CAST(count_if(step <> 0) OVER () AS BIGINT)
  FROM (SELECT *, goal - quantity AS step, CAST(floor(abs((goal - quantity) * price) * 3.25::DOUBLE / 1e4) AS BIGINT) AS fee
        FROM (SELECT *, CASE WHEN now IS NULL THEN quantity ELSE CAST(floor(free * 0.99935::DOUBLE * weight / price / 10) AS BIGINT) * 10 END AS goal
              FROM (SELECT u.i, u.ts, u.symbol, u.cents AS now, u.weight, k.quantity, coalesce(u.cents, k.cents) AS price, k.cash, k.cash + sum(k.quantity * coalesce(u.cents, k.cents)) OVER () AS worth,
                           k.cash + sum(CASE WHEN u.cents IS NULL THEN 0 ELSE k.quantity * u.cents END) OVER () AS free
                    FROM k JOIN u ON u.i = k.i + 1 AND u.symbol = k.symbol))))
SELECT DISTINCT ts, cash AS cash_cents, equity AS equity_cents, fees AS fees_cents, traded AS orders FROM k WHERE i > 0"""


@query("portfolio", PORTFOLIO)
def _(spark, d):
    bars = A.monthly_bars(spark, d)
    score = F.col("close") / F.lag("close", 3).over(indicators.by_symbol())
    rows = portfolio.rebalanced(portfolio.targets(bars, score, 2), 5_000_000_000, lot=10, fee_bps=3.25)
    return rows.select("ts", "cash_cents", "equity_cents", "fees_cents", F.size("orders").cast("long").alias("orders"))


@query("load_oldest", BASE.rstrip() + f""",
n AS (SELECT * FROM c WHERE symbol = 'view' AND ts >= TIMESTAMP '2024-01-02 14:00:00' AND ts < TIMESTAMP '2024-01-20 03:00:00' ORDER BY ts LIMIT 100)
SELECT n.symbol, time_bucket(INTERVAL 60 MINUTE, n.ts, s.open_ts) AS ts, arg_min(open, n.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, n.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM n JOIN sess s ON CAST({LOCAL_OF.format('n.ts')} AS DATE) = s.dy GROUP BY ALL""")
def _(spark, d):
    rows = read.load(base(spark, d), A.january(spark), "view", "1h", "2024-01-02T11:00:00-03:00", "2024-01-20T03:00:00Z", limit=100)
    return rows.select("symbol", "ts", "open", "high", "low", "close", "volume")


WEIGHTED = " + ".join(f"coalesce(lag(close, {i}) OVER w, 0) * {5 - i}" for i in range(1, 5))


@query("wma_5", HOURLY + f"SELECT symbol, ts, CASE WHEN row_number() OVER w >= 5 THEN round((close * 5 + {WEIGHTED}) / 15, 6) END AS wma FROM c{IN_ORDER}")
def _(spark, d):
    return candles(spark, d, "1h").select("symbol", "ts", F.round(indicators.wma(F.col("close"), 5), 6).alias("wma"))


@query("atr_14", NUMBERED_HOURS + ",\n" + RANGES + ",\n" + ema_sql("a14", "r", "t", 14, 1, "1.0::DOUBLE / 14") + "\nSELECT n.symbol, n.ts, round(e, 6) AS atr FROM n LEFT JOIN a14 USING (symbol, rn)")
def _(spark, d):
    return indicators.atr(candles(spark, d, "1h"), 14).select("symbol", "ts", rounded("atr"))


SPAN_14 = f"CASE WHEN {SEEN} >= 14 AND max(high) {ROWS.format(13)} > min(low) {ROWS.format(13)} THEN {{}} / (max(high) {ROWS.format(13)} - min(low) {ROWS.format(13)}) * {{}} END"


@query("oscillators", HOURLY + f"SELECT symbol, ts, round({SPAN_14.format(f'(close - min(low) {ROWS.format(13)})', '100')}, 6) AS stochastic, round({SPAN_14.format(f'(max(high) {ROWS.format(13)} - close)', '-100')}, 6) + 0 AS williams, round(CASE WHEN lag(close, 10) OVER w > 0 THEN (close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100 END, 6) AS roc, round(close - lag(close, 10) OVER w, 6) AS momentum FROM c{IN_ORDER}")
def _(spark, d):
    close = F.col("close")
    parts = {"stochastic": indicators.stochastic(14), "williams": indicators.williams(14), "roc": indicators.rate_of_change(close, 10), "momentum": indicators.momentum(close, 10)}
    return candles(spark, d, "1h").select("symbol", "ts", *[F.round(v, 6).alias(k) for k, v in parts.items()])


@query("volume_lines", HOURLY + f"""SELECT symbol, ts, CASE WHEN {SEEN} >= 10 AND sum(volume) {ROWS.format(9)} > 0 THEN round(sum(close * volume) {ROWS.format(9)} / sum(volume) {ROWS.format(9)}, 6) END AS vwma,
  CASE WHEN sum(volume) OVER x > 0 THEN round(sum({TYPICAL} * volume) OVER x / sum(volume) OVER x, 6) END AS vwap, CAST(sum(moved) OVER (PARTITION BY symbol ORDER BY ts) AS BIGINT) AS obv
FROM (SELECT *, CAST({LOCAL_OF.format('ts')} AS DATE) AS dy, CASE WHEN close > lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume ELSE 0 END AS moved FROM c{IN_ORDER}) WINDOW x AS (PARTITION BY symbol, dy ORDER BY ts)""")
def _(spark, d):
    rows = candles(spark, d, "1h").withColumns({"dy": C.local_day(F.col("ts")), "moved": indicators.signed_volume()})
    running = indicators.by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("symbol", "ts", F.round(indicators.vwma(10), 6).alias("vwma"), F.round(indicators.vwap(), 6).alias("vwap"), F.sum("moved").over(running).alias("obv"))


@query("store_versions", STORED + """SELECT CAST(ascii(symbol) AS BIGINT) AS symbol_id, timeframe, ts, open, high, low, CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN close * 2 ELSE close END AS close, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN adj_close END AS adj_close, volume FROM c""")
def _(spark, d):
    old, new = (rows.withColumn("symbol_id", F.ascii("symbol").cast("long")) for rows in halves(spark, d))
    path = f"{scan.shared(spark)}/candles-{uuid.uuid4().hex}"
    store.upsert(old, path)
    store.upsert(new, path)
    return store.read(spark, path)
