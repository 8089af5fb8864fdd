"""Fixed schemas, enumerations and constants of the candle data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Exchange zone, timeframes (width in seconds, base timeframe, base bars, provider interval), kinds,
# roots and month codes of futures, tickers that need no token, currency, range tokens with days, run statuses, limits.
ZONE = "America/Sao_Paulo"
TIMEFRAMES = {
    "5m": (300, "5m", 1, "5m"),
    "15m": (900, "5m", 3, "15m"),
    "30m": (1800, "5m", 6, "30m"),
    "1h": (3600, "5m", 12, "60m"),
    "1d": (86400, "1d", 1, "1d"),
}
STORED = ("5m", "1d")
KINDS = ("stock", "fii", "bdr", "unit", "index", "future", "crypto")
FUTURE_ROOTS = ("WIN", "IND", "WDO", "DOL")
MONTH_CODES = "FGHJKMNQUVXZ"
FREE_TICKERS = ("ITUB4", "MGLU3", "PETR4", "VALE3")
CURRENCY = "BRL"
RANGES = (("3mo", 92), ("6mo", 183), ("1y", 366), ("2y", 731), ("5y", 1827), ("10y", 3653))
RUN_STATUSES = ("running", "ok", "empty", "skipped", "failed")
# What a response says about how long it may be kept (closed window, open window, symbols), and days of a
# daily request, sessions of a tail refresh, requests that a month's quota allows by default.
KEEP_CLOSED, KEEP_OPEN, KEEP_SYMBOLS = "public, max-age=86400, immutable", "no-cache", "public, max-age=300"
CHUNK_DAYS, SYNC_SESSIONS, SYNC_RANGE = 365, 5, "3mo"
PAGE_DEFAULT, PAGE_MAX, READ_CAP, SYMBOLS_DEFAULT, SYMBOLS_MAX = 1_000, 5_000, 50_000, 20, 100

CANDLE = T.StructType(
    [T.StructField("symbol_id", T.LongType()), T.StructField("timeframe", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")]
    + [T.StructField("volume", T.LongType())]
)
SYMBOL = (
    "id long, ticker string, short_name string, long_name string, kind string, currency string, lot_size int, "
    "tick_size double, point_value double, active boolean, tracked boolean, first_seen date, last_seen date"
)
RUN = (
    "id long, symbol_id long, timeframe string, range_start date, range_end date, status string, http_status int, "
    "bars int, rejected int, error string, started_at timestamp_ntz, finished_at timestamp_ntz, duration_ms long"
)
BAR = "date: bigint, open: double, high: double, low: double, close: double, adjustedClose: double, volume: bigint"
QUOTE = (
    "symbol string, shortName string, longName string, currency string, regularMarketPrice double, "
    f"regularMarketVolume long, regularMarketTime string, historicalDataPrice array<struct<{BAR}>>"
)


def parse_timeframe(text: str, stored: bool = False) -> str:
    """The timeframe that ``text`` names; ValueError lists the valid ones."""
    name = (text or "").strip().lower()
    allowed = STORED if stored else tuple(TIMEFRAMES)
    if name not in allowed:
        raise ValueError(f"{text!r} names no timeframe; known: {' '.join(allowed)}")
    return name


def parse_kind(text: str) -> str:
    """The instrument kind that ``text`` names; ValueError lists the valid ones."""
    name = (text or "").strip().lower()
    if name not in KINDS:
        raise ValueError(f"{text!r} names no kind of instrument; known: {' '.join(KINDS)}")
    return name


def width(timeframe: str) -> int:
    """Bucket width in seconds."""
    return TIMEFRAMES[parse_timeframe(timeframe)][0]
