"""Continuous series of futures (an extension): a roll calendar, and bars adjusted back over its rolls.

Contracts are rows (root, contract, expiry, ts, open, high, low, close, volume), one a contract and ``ts``. Which contract is in
front is settled a day; windows span a root's days or its rolls, never its bars.

Defined cases: a day without the contract in front has no bars in the series; a roll whose contracts never traded at one
time before it has null factors and leaves earlier bars as they are; contracts of one expiry are in front in the order of their
names; a null volume counts as 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def day() -> Column:
    """The day that a bar counts for."""
    return F.col("ts").cast("date")


def by_volume(bars: DataFrame) -> DataFrame:
    """(root, dy, expiry, contract) in front: the contract with the day's largest volume (of equal ones the nearest), but never one
    nearer than a day before: a roll isn't taken back."""
    volume = F.sum(F.coalesce("volume", F.lit(0)))
    traded = bars.groupBy("root", day().alias("dy"), "expiry", "contract").agg(volume.alias("_v"))
    # the largest volume, then the smallest (expiry, contract)
    best = traded.groupBy("root", "dy").agg(F.max("_v").alias("_v"))
    leader = traded.join(best, ["root", "dy", "_v"]).groupBy("root", "dy").agg(F.min(F.struct("expiry", "contract")).alias("_c"))
    front = F.max("_c").over(Window.partitionBy("root").orderBy("dy"))
    return leader.withColumn("_c", front).select("root", "dy", "_c.expiry", "_c.contract")


def by_expiry(bars: DataFrame, days: int = 5) -> DataFrame:
    """(root, dy, expiry, contract) in front: of the contracts seen by then, the nearest that expires more than ``days`` days later."""
    traded = bars.groupBy("root", "expiry", "contract").agg(F.min(day()).alias("_since"))
    dates = bars.select("root", day().alias("dy")).distinct()
    open_ = dates.join(traded, "root").where((F.date_add("dy", days) < F.col("expiry")) & (F.col("_since") <= F.col("dy")))
    return open_.groupBy("root", "dy").agg(F.min(F.struct("expiry", "contract")).alias("_c")).select("root", "dy", "_c.expiry", "_c.contract")


def rolls(bars: DataFrame, front: DataFrame) -> DataFrame:
    """The roll calendar: (root, dy, from_contract, contract, common_ts, ratio, difference): the first day of each next contract,
    and what its close was to the one before it, as ratio and as difference, at the last time before that day at which both
    traded."""
    order = Window.partitionBy("root").orderBy("dy")
    at = front.withColumn("from_contract", F.lag("contract").over(order)).where("from_contract <> contract").select("root", "dy", "from_contract", "contract")
    close = lambda name, value: bars.select("root", F.col("contract").alias(name), "ts", F.col("close").alias(value))
    both = at.join(close("from_contract", "_a"), ["root", "from_contract"]).where(day() < F.col("dy")).join(close("contract", "_b"), ["root", "contract", "ts"])
    last = both.groupBy("root", "dy").agg(F.max_by(F.struct(F.col("ts").alias("common_ts"), "_a", "_b"), "ts").alias("_l"))
    ratio = F.when(F.col("_l._a") > 0, F.col("_l._b") / F.col("_l._a"))
    return at.join(last, ["root", "dy"], "left").select("root", "dy", "from_contract", "contract", "_l.common_ts", ratio.alias("ratio"), (F.col("_l._b") - F.col("_l._a")).alias("difference"))


def factors(calendar: DataFrame) -> DataFrame:
    """(root, dy, until, factor, shift): for days from ``dy`` (null: the beginning) up to before ``until`` (null: the end), the
    product of all later rolls' ratios and the sum of their differences."""
    order = Window.partitionBy("root").orderBy("dy")
    later = order.rowsBetween(0, Window.unboundedFollowing)
    known = calendar.withColumns({"_r": F.coalesce("ratio", F.lit(1.0)), "_d": F.coalesce("difference", F.lit(0.0))})
    before = known.select("root", F.lag("dy").over(order).alias("dy"), F.col("dy").alias("until"), F.product("_r").over(later).alias("factor"), F.sum("_d").over(later).alias("shift"))
    last = calendar.groupBy("root").agg(F.max("dy").alias("dy")).select("root", "dy", F.lit(None).cast("date").alias("until"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("shift"))
    return before.unionByName(last)


def continuous(bars: DataFrame, front: DataFrame, calendar: DataFrame, how: str = "ratio") -> DataFrame:
    """The bars of the contracts in front, prices adjusted back by ``how``: "ratio" keeps every return, "difference" every step,
    "none" leaves the gaps. ``factor`` and ``shift`` tell what was done."""
    if how not in ("ratio", "difference", "none"):
        raise ValueError(f"unknown adjustment {how!r}")
    rows = bars.withColumn("dy", day()).join(front.select("root", "dy", "contract"), ["root", "dy", "contract"])
    spans = factors(calendar).select("root", F.col("dy").alias("_since"), "until", "factor", "shift")
    inside = (F.col("_since").isNull() | (F.col("dy") >= F.col("_since"))) & (F.col("until").isNull() | (F.col("dy") < F.col("until")))
    # rolls of a root are few: each day meets its one span in a join on the root's days, not on its bars
    days = rows.select("root", "dy").distinct().join(spans, "root").where(inside).select("root", "dy", "factor", "shift")
    rows = rows.join(days, ["root", "dy"], "left")
    factor = F.coalesce("factor", F.lit(1.0)) if how == "ratio" else F.lit(1.0)
    shift = F.coalesce("shift", F.lit(0.0)) if how == "difference" else F.lit(0.0)
    rows = rows.withColumns({"factor": factor, "shift": shift})
    return rows.withColumns({c: F.col(c) * F.col("factor") + F.col("shift") for c in PRICES})
