"""Portfolios that share cash over many symbols (an extension). Money is in integer cents, quantities in whole lots.

At each time all symbols that trade then meet in one row (a cross-section: symbols are a dimension), and the portfolio is a state
machine over these rows (``scan.machine``), so its length is split like any series'.

Defined cases: a symbol without a price at a time can't be traded then and counts with its last price; a price that isn't
positive is none; a null score is never chosen; equal scores are told apart by symbol; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.ext import scan


def targets(candles: DataFrame, score: Column, top: int) -> DataFrame:
    """(ts, symbol, price, weight): the open that each symbol trades at, and equal weights for the ``top`` symbols by the score of
    their bar before, so that nothing is decided by the bar it is traded in."""
    before = F.lag("_score").over(Window.partitionBy("symbol").orderBy("ts"))
    rows = candles.withColumn("_score", score).withColumn("_before", before)
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.desc_nulls_last("_before"), "symbol"))
    rows = rows.withColumn("_in", (place <= top) & F.col("_before").isNotNull())
    chosen = F.count_if("_in").over(Window.partitionBy("ts"))
    return rows.select("ts", "symbol", F.col("open").alias("price"), F.when(F.col("_in"), 1 / chosen).otherwise(0.0).alias("weight"))


def rebalanced(weights: DataFrame, cash_cents: int, lot: int = 1, fee_bps: float = 0.0) -> DataFrame:
    """(ts, cash_cents, equity_cents, fees_cents, orders, held): the portfolio after each time of ``weights(ts, symbol, price,
    weight)`` (weights of a time: 1 together at most). Each symbol is brought to the lots that its share of the equity buys;
    twice the fee is kept back, so cash can't go below zero. Fees are whole cents, rounded down. ``orders`` hold symbol,
    quantity (negative: sold), cents of the price and fee_cents; ``held`` symbol, quantity and the last price."""
    ts = weights.schema["ts"].dataType.simpleString()
    order, holding = "struct<symbol: string, quantity: bigint, cents: bigint, fee: bigint>", "struct<symbol: string, quantity: bigint, cents: bigint>"
    state = f"struct<cash: bigint, equity: bigint, fees: bigint, orders: array<{order}>, held: array<{holding}>>"
    keep = 1 - 2 * fee_bps / 1e4
    total = lambda items, of: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + of(x))
    found = lambda items, symbol: F.get(F.filter(items, lambda h: h["symbol"] == symbol), 0)

    def after(s, x):
        cash = F.coalesce(s["cash"], F.lit(cash_cents).cast("long"))
        held = F.coalesce(s["held"], F.array().cast(f"array<{holding}>"))

        def priced(own):
            worth = cash + total(own, lambda h: h["quantity"] * h["cents"])
            absent = F.filter(own, lambda h: found(x["_rows"], h["symbol"]).isNull())
            free = worth - total(absent, lambda h: h["quantity"] * h["cents"])

            def sized(share):
                """The orders of every symbol that trades now, and what is held after them."""

                def asked(r):
                    to = F.floor(share * r["weight"] / r["cents"] / lot).cast("long") * lot
                    return F.struct(r["symbol"].alias("symbol"), (to - F.coalesce(found(own, r["symbol"])["quantity"], F.lit(0).cast("long"))).alias("quantity"), r["cents"].alias("cents"), to.alias("to"))

                def settled(all_):
                    orders = F.transform(F.filter(all_, lambda o: o["quantity"] != 0), lambda o: F.struct(o["symbol"].alias("symbol"), o["quantity"].alias("quantity"), o["cents"].alias("cents"), F.floor(F.abs(o["quantity"] * o["cents"]) * fee_bps / 1e4).cast("long").alias("fee")))
                    left = F.concat(F.transform(F.filter(all_, lambda o: o["to"] > 0), lambda o: F.struct(o["symbol"].alias("symbol"), o["to"].alias("quantity"), o["cents"].alias("cents"))), absent)

                    def closed(orders):
                        fees = total(orders, lambda o: o["fee"])
                        rest = cash - total(orders, lambda o: o["quantity"] * o["cents"]) - fees
                        return F.struct(rest.alias("cash"), (worth - fees).alias("equity"), fees.alias("fees"), orders.alias("orders"), left.alias("held"))

                    return scan.once(orders, closed)

                return scan.once(F.transform(x["_rows"], asked), settled)

            return scan.once(free * keep, sized)

        now = F.transform(held, lambda h: F.struct(h["symbol"].alias("symbol"), h["quantity"].alias("quantity"), F.coalesce(found(x["_rows"], h["symbol"])["cents"], h["cents"]).alias("cents")))
        return scan.once(now, priced)

    cents = F.bround(F.col("price") * 100).cast("long")
    rows = weights.where("price > 0").select("ts", F.struct("symbol", cents.alias("cents"), F.coalesce("weight", F.lit(0.0)).alias("weight")).alias("_r")).where("_r.cents > 0")
    rows = rows.groupBy("ts").agg(F.array_sort(F.collect_list("_r")).alias("_rows")).withColumn("portfolio", F.lit(0))
    states = scan.machine(scan.numbered(rows, ("portfolio",)), state, after, ("portfolio",))
    return states.select(F.col("ts").cast(ts).alias("ts"), F.col("_state.cash").alias("cash_cents"), F.col("_state.equity").alias("equity_cents"), F.col("_state.fees").alias("fees_cents"), "_state.orders", "_state.held")
