"""Technical indicators over candles (an extension). Windowed ones are column expressions; those whose state depends on every
earlier bar are scans over blocks of bars (``ext/scan.py``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.ext import scan

SOURCES = {
    "open": lambda: F.col("open"),
    "high": lambda: F.col("high"),
    "low": lambda: F.col("low"),
    "close": lambda: F.col("close"),
    "hl2": lambda: (F.col("high") + F.col("low")) / 2,
    "hlc3": lambda: (F.col("high") + F.col("low") + F.col("close")) / 3,
    "ohlc4": lambda: (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4,
}


def by_symbol():
    """Bars of a symbol in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def last(n: int):
    """The newest ``n`` bars up to the current one."""
    return by_symbol().rowsBetween(-(n - 1), 0)


def warm(value: Column, n: int) -> Column:
    """``value`` from the n-th bar on, null before."""
    return F.when(F.row_number().over(by_symbol()) >= n, value)


def sma(source: Column, n: int) -> Column:
    """Simple moving average."""
    return warm(F.avg(source).over(last(n)), n)


def deviation(source: Column, n: int) -> Column:
    """Population standard deviation."""
    return warm(F.stddev_pop(source).over(last(n)), n)


def bollinger(source: Column, n: int = 20, k: float = 2.0) -> list[Column]:
    """Middle, upper and lower band."""
    mid, dev = sma(source, n), deviation(source, n)
    return [mid.alias("middle"), (mid + k * dev).alias("upper"), (mid - k * dev).alias("lower")]


def wma(source: Column, n: int) -> Column:
    """Linearly weighted moving average."""
    total = sum((F.coalesce(F.lag(source, i).over(by_symbol()), F.lit(0.0)) * (n - i) for i in range(1, n)), source * n)
    return warm(total / (n * (n + 1) / 2), n)


def donchian(n: int = 20) -> list[Column]:
    """Highest high, lowest low and their middle."""
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return [warm(hi, n).alias("upper"), warm(lo, n).alias("lower"), warm((hi + lo) / 2, n).alias("middle")]


def true_range() -> Column:
    """Largest of the bar's span and its distances from the close before."""
    before = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def stochastic(n: int = 14) -> Column:
    """%K of the last n bars."""
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return warm(F.when(hi > lo, (F.col("close") - lo) / (hi - lo) * 100), n)


def williams(n: int = 14) -> Column:
    """Williams %R."""
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return warm(F.when(hi > lo, (hi - F.col("close")) / (hi - lo) * -100), n)


def rate_of_change(source: Column, n: int) -> Column:
    """Change in percent over n bars."""
    before = F.lag(source, n).over(by_symbol())
    return F.when(before > 0, (source - before) / before * 100)


def momentum(source: Column, n: int) -> Column:
    """Difference over n bars."""
    return source - F.lag(source, n).over(by_symbol())


def vwap() -> Column:
    """Volume-weighted average price since the session began (needs dy)."""
    w = Window.partitionBy("symbol", "dy").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("volume").over(w)
    return F.when(total > 0, F.sum(SOURCES["hlc3"]() * F.col("volume")).over(w) / total)


def vwma(n: int) -> Column:
    """Volume-weighted moving average."""
    total = F.sum("volume").over(last(n))
    return warm(F.when(total > 0, F.sum(F.col("close") * F.col("volume")).over(last(n)) / total), n)


def signed_volume() -> Column:
    """Volume with the sign of the close's direction; its running sum is the on-balance volume."""
    before = F.lag("close").over(by_symbol())
    return F.when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0)


def commodity_channel(n: int = 20) -> Column:
    """CCI: distance of the typical price from its average, in mean deviations (of which 0.015 is the unit)."""
    price = SOURCES["hlc3"]()
    held, mean = F.collect_list(price).over(last(n)), F.avg(price).over(last(n))
    spread = F.aggregate(F.transform(held, lambda x: F.abs(x - mean)), F.lit(0.0), lambda a, x: a + x) / n
    return warm(F.when(spread > 0, (price - mean) / (spread * 0.015)), n)


def aroon(n: int = 25) -> list[Column]:
    """Aroon up and down: how recent the highest high and the lowest low of the last n + 1 bars are, in percent."""
    highs, lows = (F.reverse(F.collect_list(c).over(last(n + 1))) for c in ("high", "low"))
    recent = lambda held, top: warm((n + 1 - F.array_position(held, top(held))) * 100.0 / n, n + 1)
    return [recent(highs, F.array_max).alias("up"), recent(lows, F.array_min).alias("down")]


def flow_volume() -> Column:
    """Volume with the sign and share of the close's place in its bar; its running sum is the A/D line."""
    span = F.col("high") - F.col("low")
    place = F.when(span > 0, (2 * F.col("close") - F.col("low") - F.col("high")) / span).otherwise(0.0)
    return place * F.coalesce("volume", F.lit(0))


def accumulation() -> Column:
    """Accumulation/distribution line."""
    return F.sum(flow_volume()).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def chaikin_flow(n: int = 20) -> Column:
    """Chaikin money flow: the A/D line's step over n bars by their volume."""
    total = F.sum("volume").over(last(n))
    return warm(F.when(total > 0, F.sum(flow_volume()).over(last(n)) / total), n)


def money_flow(candles: DataFrame, n: int = 14) -> DataFrame:
    """``mfi``: share of the money (typical price times volume) of rising bars in that of all moving ones, n bars."""
    rows = candles.withColumn("_p", SOURCES["hlc3"]()).withColumn("_b", F.lag("_p").over(by_symbol()))
    money = F.col("_p") * F.coalesce("volume", F.lit(0))
    side = lambda moved: F.sum(F.when(moved, money).otherwise(0.0)).over(last(n))
    up, down = side(F.col("_p") > F.col("_b")), side(F.col("_p") < F.col("_b"))
    return rows.withColumn("mfi", warm(F.when(up + down > 0, up / (up + down) * 100), n + 1)).drop("_p", "_b")


def historical_volatility(candles: DataFrame, n: int = 20, periods: int = 252) -> DataFrame:
    """``hv``: sample deviation of the last n log returns, for a year of ``periods`` bars, in percent."""
    rows = candles.withColumn("_r", F.log(F.col("close") / F.lag("close").over(by_symbol())))
    return rows.withColumn("hv", warm(F.stddev_samp("_r").over(last(n)) * F.sqrt(F.lit(float(periods))) * 100, n + 1)).drop("_r")


def hull(candles: DataFrame, n: int = 16) -> DataFrame:
    """``hma``: weighted average over sqrt(n) bars of twice the average of n / 2 bars less that of n."""
    short, smooth = n // 2, int(n**0.5)
    rows = candles.withColumn("_h", 2 * wma(F.col("close"), short) - wma(F.col("close"), n))
    return rows.withColumn("hma", F.when(F.row_number().over(by_symbol()) >= n + smooth - 1, wma(F.col("_h"), smooth))).drop("_h")


def ichimoku(candles: DataFrame, fast: int = 9, base: int = 26, slow: int = 52) -> DataFrame:
    """``conversion`` and ``base``, ``span_a`` and ``span_b`` (``base`` bars ahead), ``lagging`` (as many back)."""
    middle = lambda n: donchian(n)[2]
    rows = candles.withColumns({"conversion": middle(fast), "base": middle(base), "_m": middle(slow)})
    ahead = lambda c: F.lag(c, base).over(by_symbol())
    spans = {"span_a": ahead((F.col("conversion") + F.col("base")) / 2), "span_b": ahead("_m"), "lagging": F.lead("close", base).over(by_symbol())}
    return rows.withColumns(spans).drop("_m")


def fractals(side: int = 2) -> list[Column]:
    """Whether a bar's high (low) is beyond those of ``side`` bars before and after it; false at the ends."""
    near = [i for k in range(1, side + 1) for i in (-k, k)]
    beyond = lambda c, test: F.coalesce(F.reduce(F.array(*[test(F.col(c), F.lag(c, i).over(by_symbol())) for i in near]), F.lit(True), lambda a, x: a & x), F.lit(False))
    return [beyond("high", lambda a, b: a > b).alias("fractal_high"), beyond("low", lambda a, b: a < b).alias("fractal_low")]


def pivots() -> list[Column]:
    """Classic pivot with two supports and resistances, from the bar before (of daily candles: the session before)."""
    high, low, close = (F.lag(c).over(by_symbol()) for c in ("high", "low", "close"))
    p = (high + low + close) / 3
    return [p.alias("pivot"), (2 * p - low).alias("r1"), (2 * p - high).alias("s1"), (p + high - low).alias("r2"), (p - high + low).alias("s2")]


def ema(candles: DataFrame, n: int, source: str = "close") -> DataFrame:
    """Exponential moving average in ``ema``."""
    rows = scan.numbered(candles.withColumn("_s", SOURCES[source]()))
    return scan.plain(scan.smoothed(rows, ema=("_s", n, 2 / (n + 1), 0)))


def rsi(candles: DataFrame, n: int = 14) -> DataFrame:
    """Relative strength index in ``rsi``, by Wilder's smoothing."""
    rows = scan.before(scan.numbered(candles), _before="close")
    step = F.col("close") - F.col("_before")
    rows = rows.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))})
    rows = scan.smoothed(rows, _u=("_up", n, 1 / n, 1), _d=("_down", n, 1 / n, 1))
    return scan.plain(rows.withColumn("rsi", F.when(F.col("_d") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_u") / F.col("_d")))))


def macd(candles: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, its signal line and their difference."""
    rows = scan.smoothed(scan.numbered(candles), _f=("close", fast, 2 / (fast + 1), 0), _w=("close", slow, 2 / (slow + 1), 0))
    rows = rows.withColumn("macd", F.col("_f") - F.col("_w"))
    rows = scan.smoothed(rows, macd_signal=("macd", signal, 2 / (signal + 1), max(fast, slow) - 1))
    return scan.plain(rows.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")))


def ranged(candles: DataFrame) -> DataFrame:
    """Numbered candles with the true range ``_t`` and the bar before in ``_close``, ``_high`` and ``_low``."""
    rows = scan.before(scan.numbered(candles), _close="close", _high="high", _low="low")
    return rows.withColumn("_t", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_close")), F.abs(F.col("low") - F.col("_close"))))


def atr(candles: DataFrame, n: int = 14) -> DataFrame:
    """Average true range in ``atr``, by Wilder's smoothing."""
    return scan.plain(scan.smoothed(ranged(candles), atr=("_t", n, 1 / n, 0)))


def dema_tema(candles: DataFrame, n: int = 10) -> DataFrame:
    """``dema`` and ``tema``: exponential averages with one and two corrections of their lag."""
    rows, source = scan.numbered(candles), "close"
    for k, name in enumerate(("_e1", "_e2", "_e3")):
        rows, source = scan.smoothed(rows, **{name: (source, n, 2 / (n + 1), k * (n - 1))}), name
    one, two, three = (F.col(c) for c in ("_e1", "_e2", "_e3"))
    return scan.plain(rows.withColumns({"dema": 2 * one - two, "tema": 3 * one - 3 * two + three}))


def keltner(candles: DataFrame, n: int = 20, span: int = 10, k: float = 2.0) -> DataFrame:
    """``middle`` (exponential average), ``upper`` and ``lower`` (``k`` average true ranges away)."""
    rows = ema(atr(candles, span), n)
    return rows.withColumns({"upper": F.col("ema") + k * F.col("atr"), "lower": F.col("ema") - k * F.col("atr")}).withColumnRenamed("ema", "middle").drop("atr")


def stochastic_rsi(candles: DataFrame, n: int = 14) -> DataFrame:
    """``stoch_rsi``: place of the RSI between its lowest and highest of n bars, in percent."""
    rows = rsi(candles, n).withColumn("_r", F.nanvl("rsi", F.lit(None).cast("double")))
    high, low, seen = (f("_r").over(last(n)) for f in (F.max, F.min, F.count))
    return rows.withColumn("stoch_rsi", F.when((seen == n) & (high > low), (F.col("_r") - low) / (high - low) * 100)).drop("_r", "rsi")


def directional(candles: DataFrame, n: int = 14) -> DataFrame:
    """``plus_di``, ``minus_di`` and ``adx``, by Wilder's smoothing of the averages' form."""
    rows = ranged(candles)
    up, down = F.col("high") - F.col("_high"), F.col("_low") - F.col("low")
    rows = rows.withColumns({"_up": F.when((up > down) & (up > 0), up).otherwise(0.0), "_down": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    rows = scan.smoothed(rows, _at=("_t", n, 1 / n, 1), _pt=("_up", n, 1 / n, 1), _mt=("_down", n, 1 / n, 1))
    share = lambda c: F.when(F.col("_at") > 0, F.col(c) / F.col("_at") * 100).when(F.col("_at").isNotNull(), 0.0)
    rows = rows.withColumns({"plus_di": share("_pt"), "minus_di": share("_mt")})
    both, apart = F.col("plus_di") + F.col("minus_di"), F.abs(F.col("plus_di") - F.col("minus_di"))
    rows = rows.withColumn("_apart", F.when(both > 0, apart / both * 100).when(both.isNotNull(), 0.0))
    return scan.plain(scan.smoothed(rows, adx=("_apart", n, 1 / n, n)))


def parabolic(candles: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """``psar`` and ``psar_up``: Wilder's stop and reverse, from the second bar on. It rises (falls) to the trend's extreme by an
    acceleration that grows with each new extreme, stays outside the two bars before, and flips where a bar crosses it, to
    the extreme (or the bar's own, where that lies beyond). The first trend is down where the second close is below the first."""
    state = "struct<up: boolean, sar: double, ep: double, af: double, h1: double, l1: double, h2: double, l2: double, close: double>"

    def after(s, x):
        entry = lambda up, sar, ep, af, h2, l2: F.struct(*[c.alias(n) for c, n in zip((up, sar, ep, af, x["high"], x["low"], h2, l2, x["close"]), ("up", "sar", "ep", "af", "h1", "l1", "h2", "l2", "close"))])
        nothing = F.lit(None).cast("double")
        first = entry(F.lit(None).cast("boolean"), nothing, nothing, nothing, x["high"], x["low"])
        rises = ~(x["close"] < s["close"])
        second = entry(rises, F.when(rises, s["l1"]).otherwise(s["h1"]), F.when(rises, F.greatest(s["h1"], x["high"])).otherwise(F.least(s["l1"], x["low"])), F.lit(start), s["h1"], s["l1"])

        def moved(sar):
            crossed = F.when(s["up"], x["low"] < sar).otherwise(x["high"] > sar)
            beyond = F.when(s["up"], x["high"] > s["ep"]).otherwise(x["low"] < s["ep"])
            turned = entry(~s["up"], F.when(s["up"], F.greatest(s["ep"], x["high"])).otherwise(F.least(s["ep"], x["low"])), F.when(s["up"], x["low"]).otherwise(x["high"]), F.lit(start), s["h1"], s["l1"])
            went = entry(s["up"], sar, F.when(beyond, F.when(s["up"], x["high"]).otherwise(x["low"])).otherwise(s["ep"]), F.when(beyond, F.least(s["af"] + step, F.lit(most))).otherwise(s["af"]), s["h1"], s["l1"])
            return F.when(crossed, turned).otherwise(went)

        sar = s["sar"] + s["af"] * (s["ep"] - s["sar"])
        sar = F.when(s["up"], F.least(sar, s["l1"], s["l2"])).otherwise(F.greatest(sar, s["h1"], s["h2"]))
        return F.when(s.isNull(), first).when(s["up"].isNull(), second).otherwise(scan.once(sar, moved))

    rows = scan.machine(scan.numbered(candles), state, after)
    return scan.plain(rows.withColumns({"psar": F.col("_state.sar"), "psar_up": F.col("_state.up")}))


def supertrend(candles: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    """``supertrend`` and ``supertrend_up``: bands ``k`` average true ranges from the middle of the bar, the upper only falling
    and the lower only rising until a close crosses them. The line is the lower band in a rising trend, which ends with a close
    below it, and the upper in a falling one; it begins with the average true range, rising if the close isn't below the
    bar's middle."""
    state = "struct<upper: double, lower: double, up: boolean, close: double>"
    rows = scan.smoothed(ranged(candles), _atr=("_t", n, 1 / n, 0))
    middle = (F.col("high") + F.col("low")) / 2
    rows = rows.withColumns({"_over": middle + k * F.col("_atr"), "_under": middle - k * F.col("_atr"), "_rises": F.col("close") >= middle})

    def after(s, x):
        entry = lambda upper, lower, up: F.struct(upper.alias("upper"), lower.alias("lower"), up.alias("up"), x["close"].alias("close"))
        upper = F.when((x["_over"] < s["upper"]) | (s["close"] > s["upper"]), x["_over"]).otherwise(s["upper"])
        lower = F.when((x["_under"] > s["lower"]) | (s["close"] < s["lower"]), x["_under"]).otherwise(s["lower"])
        up = F.when(s["up"], ~(x["close"] < lower)).otherwise(x["close"] > upper)
        return F.when(x["_over"].isNull(), F.lit(None).cast(state)).when(s.isNull(), entry(x["_over"], x["_under"], x["_rises"])).otherwise(entry(upper, lower, up))

    rows = scan.machine(rows, state, after)
    line = F.when(F.col("_state.up"), F.col("_state.lower")).otherwise(F.col("_state.upper"))
    return scan.plain(rows.withColumns({"supertrend": line, "supertrend_up": F.col("_state.up")}))


def zigzag(candles: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Pivots (symbol, kind, ts, price, confirmed_ts, open): highs and lows in turn, each confirmed by the first later bar that
    lies the fraction ``threshold`` away from it, so a confirmed pivot never changes. The extreme of the leg that isn't
    confirmed yet is the one row with ``open`` true and no confirmed_ts. A bar that extends a leg doesn't turn it; before the
    first reversal the highest and the lowest bar so far are watched, a rise wins over a fall in one bar; of equal extremes the
    first counts."""
    ts = candles.schema["ts"].dataType.simpleString()
    state = f"struct<side: int, ext: double, ext_ts: {ts}, low: double, low_ts: {ts}, pivot: double, pivot_ts: {ts}>"
    names = ("side", "ext", "ext_ts", "low", "low_ts", "pivot", "pivot_ts")

    def after(s, x):
        none, never = F.lit(None).cast("double"), F.lit(None).cast(ts)
        entry = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
        leg = lambda side, ext, at, pivot=none, when=never: entry(F.lit(side), ext, at, none, never, pivot, when)
        first = entry(F.lit(0), x["high"], x["ts"], x["low"], x["ts"], none, never)
        higher, lower = x["high"] > s["ext"], x["low"] < s["low"]
        watch = entry(F.lit(0), F.when(higher, x["high"]).otherwise(s["ext"]), F.when(higher, x["ts"]).otherwise(s["ext_ts"]), F.when(lower, x["low"]).otherwise(s["low"]), F.when(lower, x["ts"]).otherwise(s["low_ts"]), none, never)
        up, down = leg(1, x["high"], x["ts"]), leg(-1, x["low"], x["ts"])
        falls, rises = x["low"] <= s["ext"] * (1 - threshold), x["high"] >= s["ext"] * (1 + threshold)
        begun = F.when(x["high"] >= s["low"] * (1 + threshold), leg(1, x["high"], x["ts"], s["low"], s["low_ts"])).when(falls, leg(-1, x["low"], x["ts"], s["ext"], s["ext_ts"])).otherwise(watch)
        rising = F.when(higher, up).when(falls, leg(-1, x["low"], x["ts"], s["ext"], s["ext_ts"])).otherwise(leg(1, s["ext"], s["ext_ts"]))
        falling = F.when(x["low"] < s["ext"], down).when(rises, leg(1, x["high"], x["ts"], s["ext"], s["ext_ts"])).otherwise(leg(-1, s["ext"], s["ext_ts"]))
        return F.when(s.isNull(), first).when(s["side"] == 0, begun).when(s["side"] == 1, rising).otherwise(falling)

    rows = scan.machine(scan.numbered(candles.select("symbol", "ts", "high", "low")), state, after)
    kind = lambda side: F.when(side == 1, "low").otherwise("high").alias("kind")
    done = rows.where("_state.pivot IS NOT NULL").select("symbol", kind(F.col("_state.side")), F.col("_state.pivot_ts").alias("ts"), F.col("_state.pivot").alias("price"), F.col("ts").alias("confirmed_ts"), F.lit(False).alias("open"))
    last = rows.groupBy("symbol").agg(F.max_by("_state", "_n").alias("s")).where("s.side <> 0")
    return done.unionByName(last.select("symbol", kind(-F.col("s.side")), F.col("s.ext_ts").alias("ts"), F.col("s.ext").alias("price"), F.lit(None).cast(ts).alias("confirmed_ts"), F.lit(True).alias("open")))
