"""Backtests and metrics over candles with entry and exit signals (an extension). Money is in integer cents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.ext import scan

#: Most rows of a grid that are copied to every task.
GRID_ROWS = 100_000


def fills(candles: DataFrame) -> DataFrame:
    """Candles with the price and time that a signal at their close fills at: the next bar's open."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return candles.withColumn("fill_price", F.lead("open").over(w)).withColumn("fill_ts", F.lead("ts").over(w))


def backtest(
    signals: DataFrame, quantity: int = 100, stop: float | None = None, target: float | None = None, slippage_bps: float = 0.0, fee_bps: float = 0.0, lot: int = 1,
    tick: float | None = None, close_at_end: bool = False,
) -> DataFrame:
    """Long trades of candles with ``enter`` and ``leave``, as a state machine over blocks of bars (``scan.machine``): (symbol,
    entry_ts, exit_ts, lots, entry_cents, exit_cents, fee_cents, profit_cents, reason, ambiguous).

    A position opens at the open after its signal and closes at the open after a leave signal, or inside a bar at its stop or
    target (fractions of the entry); where one bar reaches both, the stop wins and ``ambiguous`` is true. Slippage moves fills
    against the trade. With a ``tick``, prices are whole ticks, rounded against the trade: purchases up, sales and stops down,
    targets up. ``close_at_end`` sells what is still held at the last bar's close, with reason "end"."""
    unit, size, ts = tick or 1.0, quantity // lot * lot, signals.schema["ts"].dataType.simpleString()
    buy = (lambda p: F.ceil(p / tick - 1e-9).cast("double")) if tick else (lambda p: p)
    sell = (lambda p: F.floor(p / tick + 1e-9).cast("double")) if tick else (lambda p: p)
    none = F.lit(None).cast("double")
    names = ("pending", "held", "since", "out", "reason", "both")
    state = f"struct<pending: int, held: double, since: {ts}, out: double, reason: string, both: boolean>"

    def after(s, x):
        held = F.when(s["out"].isNull(), s["held"])
        opens = F.coalesce((s["pending"] == 1) & held.isNull(), F.lit(False))
        leaves = F.coalesce((s["pending"] == -1) & held.isNotNull(), F.lit(False))
        pending = F.when(x["leave"], -1).when(x["enter"], 1).otherwise(0)

        def then(h):
            floor = none if stop is None else F.floor(h * (1 - stop) + 1e-9).cast("double") if tick else h * (1 - stop)
            roof = none if target is None else F.ceil(h * (1 + target) - 1e-9).cast("double") if tick else h * (1 + target)
            stopped, hit = F.coalesce(x["low"] / unit <= floor + (1e-9 if tick else 0), F.lit(False)), F.coalesce(x["high"] / unit >= roof - (1e-9 if tick else 0), F.lit(False))
            out = F.when(leaves, sell(x["open"] * (1 - slippage_bps / 1e4))).when(stopped, F.least(sell(x["open"]), floor)).when(hit, F.greatest(sell(x["open"]), roof))
            reason = F.when(leaves, "signal").when(stopped, "stop").when(hit, "target")
            since = F.when(opens, x["ts"]).when(h.isNotNull(), s["since"])
            return F.struct(*[v.alias(n) for v, n in zip((pending, h, since, out, reason, ~leaves & stopped & hit), names)])

        return scan.once(F.when(opens, buy(x["open"] * (1 + slippage_bps / 1e4))).otherwise(held), then)

    bars = signals.select("symbol", "ts", "open", "high", "low", "close", F.coalesce("enter", F.lit(False)).alias("enter"), F.coalesce("leave", F.lit(False)).alias("leave"))
    rows = scan.machine(scan.numbered(bars), state, after)
    done = rows.where("_state.out IS NOT NULL").select("symbol", "ts", "_state")
    if close_at_end:
        last = rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "_state"), "_n").alias("x")).where("x._state.held IS NOT NULL AND x._state.out IS NULL")
        sold = F.col("x._state").withField("out", sell(F.col("x.close") * (1 - slippage_bps / 1e4))).withField("reason", F.lit("end"))
        done = done.unionByName(last.select("symbol", F.col("x.ts").alias("ts"), sold.cast(state).alias("_state")))
    cents = lambda c: F.bround(F.col(c) * (unit * 100)).cast("long") * size
    done = done.select("symbol", F.col("_state.since").alias("entry_ts"), F.col("ts").alias("exit_ts"), F.lit(size).cast("long").alias("lots"), cents("_state.held").alias("entry_cents"), cents("_state.out").alias("exit_cents"), "_state.reason", F.col("_state.both").alias("ambiguous"))
    done = done.withColumn("fee_cents", F.bround((F.col("entry_cents") + F.col("exit_cents")) * fee_bps / 1e4).cast("long"))
    return done.withColumn("profit_cents", F.col("exit_cents") - F.col("entry_cents") - F.col("fee_cents")).select("symbol", "entry_ts", "exit_ts", "lots", "entry_cents", "exit_cents", "fee_cents", "profit_cents", "reason", "ambiguous")


def drawdown(equity: DataFrame, value: str = "equity") -> DataFrame:
    """Distance of a running value from its highest so far, as a fraction."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(value).over(w)
    return equity.withColumn("peak", peak).withColumn("drawdown", F.when(peak > 0, (peak - F.col(value)) / peak))


def metrics(trades: DataFrame) -> DataFrame:
    """Trades, wins, win rate, profit, profit factor and largest loss per symbol."""
    win, loss = F.col("profit_cents") > 0, F.col("profit_cents") < 0
    gain, cost = F.sum(F.when(win, F.col("profit_cents")).otherwise(0)), F.sum(F.when(loss, -F.col("profit_cents")).otherwise(0))
    return trades.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.count_if(win).alias("wins"), (F.count_if(win) / F.count("*")).alias("win_rate"), F.sum("profit_cents").alias("profit_cents"),
        F.when(cost > 0, gain / cost).alias("profit_factor"), F.min("profit_cents").alias("worst_cents"),
    )


def return_metrics(equity: DataFrame, value: str = "equity", periods: int = 252) -> DataFrame:
    """Per symbol, over a positive running value with ``periods`` steps a year: total return, CAGR, volatility, largest
    drawdown, Sharpe, Sortino and Calmar ratio (without a riskless rate). Null where a ratio's divisor is 0."""
    before = F.lag(value).over(Window.partitionBy("symbol").orderBy("ts"))
    rows = drawdown(equity, value).withColumn("_step", F.col(value) / before - 1)
    year = F.sqrt(F.lit(float(periods)))
    per = rows.groupBy("symbol").agg(
        F.count("_step").alias("steps"), F.min_by(value, "ts").alias("_first"), F.max_by(value, "ts").alias("_last"), F.avg("_step").alias("_mean"), F.stddev_samp("_step").alias("_dev"),
        F.sqrt(F.avg(F.when(F.col("_step").isNotNull(), F.pow(F.least("_step", F.lit(0.0)), 2)))).alias("_down"), F.max("drawdown").alias("max_drawdown"),
    )
    growth = F.col("_last") / F.col("_first")
    per = per.withColumns({"total_return": growth - 1, "cagr": F.when(F.col("steps") > 0, F.pow(growth, F.lit(float(periods)) / F.col("steps")) - 1), "volatility": F.col("_dev") * year})
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return per.select(
        "symbol", "steps", "total_return", "cagr", "volatility", "max_drawdown",
        (ratio("_mean", "_dev") * year).alias("sharpe"), (ratio("_mean", "_down") * year).alias("sortino"), ratio("cagr", "max_drawdown").alias("calmar"),
    )


def every_run(candles: DataFrame, grid: DataFrame) -> DataFrame:
    """Candles once a row of ``grid`` (with ``run_id``), which all tasks get where it is small; ``symbol`` becomes (symbol, run_id),
    so that what is computed by symbol is computed by run."""
    grid = F.broadcast(grid) if grid.count() <= GRID_ROWS else grid
    return candles.crossJoin(grid).withColumn("symbol", F.struct("symbol", "run_id"))


def sweep(candles: DataFrame, grid: DataFrame, signal, **costs) -> DataFrame:
    """Backtests of every parameter row of ``grid`` (with ``run_id``) over every symbol, in parallel: trades with run_id."""
    trades = backtest(signal(every_run(candles, grid)), **costs)
    return trades.withColumns({"run_id": F.col("symbol.run_id"), "symbol": F.col("symbol.symbol")})


def windows(candles: DataFrame, train: int, test: int) -> DataFrame:
    """(dy, window, role) over the days that have candles: window w trains on ``train`` days from day w * ``test`` on and is tested on
    the ``test`` days after these. Days are numbered by a window in one task: they are a dimension."""
    days = candles.select(F.col("ts").cast("date").alias("dy")).distinct()
    n = F.row_number().over(Window.orderBy("dy")) - 1
    days = days.withColumns({"_n": n, "_of": F.count("*").over(Window.partitionBy(F.lit(0)))})
    used = f"window >= 0 AND window * {test} + {train} < _of"  # a window needs a day to be tested on
    first, last = F.ceil((F.col("_n") - train + 1) / test).cast("int"), F.floor(F.col("_n") / test).cast("int")
    trained = days.where(first <= last).select("dy", "_of", F.explode(F.sequence(first, last)).alias("window"), F.lit("train").alias("role")).where(used)
    tested = days.where(F.col("_n") >= train).select("dy", "_of", F.floor((F.col("_n") - train) / test).cast("int").alias("window"), F.lit("test").alias("role")).where(used)
    return trained.unionByName(tested).drop("_of")


def walk_forward(candles: DataFrame, grid: DataFrame, signal, train: int, test: int, start_cents: int = 0, **costs) -> DataFrame:
    """Walk-forward analysis: in every window of every symbol, the run whose trades of the training days profit most (of equal
    ones the smallest run_id) trades the test days; their trades in order of exit, with the running equity in cents.

    Signals may look back over all earlier bars, but positions begin and end inside their days (what is held at the end of
    them is sold at the last close), so no choice depends on a bar after its training days and no trade on one after
    its own. A run without trades has a profit of 0."""
    rows = signal(every_run(candles, grid)).withColumn("dy", F.col("ts").cast("date")).join(windows(candles, train, test), "dy")
    rows = rows.withColumn("symbol", F.struct("symbol.symbol", "symbol.run_id", "window", "role"))
    rows = scan.kept(rows.select("symbol", "ts", "open", "high", "low", "close", "enter", "leave"))
    trades = scan.kept(backtest(rows, close_at_end=True, **costs).select(F.col("symbol").alias("of"), *[c for c in ("entry_ts", "exit_ts", "lots", "entry_cents", "exit_cents", "fee_cents", "profit_cents", "reason")]))
    profit = trades.where("of.role = 'train'").groupBy("of").agg(F.sum("profit_cents").alias("profit"))
    runs = rows.where("symbol.role = 'train'").select(F.col("symbol").alias("of")).distinct().join(profit, "of", "left").select("of.symbol", "of.window", "of.run_id", F.coalesce("profit", F.lit(0)).alias("profit"))
    best = F.row_number().over(Window.partitionBy("symbol", "window").orderBy(F.desc("profit"), "run_id"))
    chosen = runs.withColumn("_b", best).where("_b = 1").select("symbol", "window", "run_id", F.col("profit").alias("train_cents"))
    out = trades.where("of.role = 'test'").select("of.symbol", "of.window", "of.run_id", *trades.columns[1:]).join(chosen, ["symbol", "window", "run_id"])
    order = Window.partitionBy("symbol").orderBy("exit_ts", "entry_ts").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("equity_cents", F.sum("profit_cents").over(order) + start_cents)
