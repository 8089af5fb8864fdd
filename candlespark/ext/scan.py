"""Recursions over a symbol's bars, spread over many tasks (an extension): no symbol is ever held by one task.

Bars are numbered within their symbol (by month, then offsets of months) and gathered in blocks of ``BLOCK``.

* ``smoothed``: averages that depend on their value at the bar before are affine maps y -> a * y + b. Maps compose, so each
  block's bars become one map, blocks of blocks one again, and values are carried into blocks from the top down, where they
  are applied bar by bar.
* ``machine``: states that don't compose (stops that flip, legs that turn) forget where they began: all blocks run at once from
  no state, then blocks whose start isn't the end of the block before run again from that, until nothing changes. The
  result is that of one run over all bars; each round settles the first block at least, and mostly all.

All of it is JVM-side. Series are told apart by the columns ``by`` (a symbol, or a symbol and a run), bars of a series by ``ts``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bars of a block, and blocks of a block of blocks.
BLOCK = 1_024
BY = ("symbol",)


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session takes a temporary folder and any other is refused, as executors
    wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="candlespark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; Spark deletes it with the frame where
    spark.cleaner.referenceTracking.cleanCheckpoints is on."""
    shared(df.sparkSession)
    return df.checkpoint()


def once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def numbered(bars: DataFrame, by: Sequence[str] = BY, block: int | None = None) -> DataFrame:
    """``bars`` with ``_n``, their place in their symbol from 0, and ``_block``. No window spans more than a symbol's month, or
    its months."""
    rows = bars.withColumn("_month", F.trunc(F.col("ts").cast("date"), "month"))
    sizes = rows.groupBy(*by, "_month").agg(F.count("*").alias("_size"))
    from_ = F.sum("_size").over(Window.partitionBy(*by).orderBy("_month")) - F.col("_size")
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "_month").orderBy("ts")) - 1)
    rows = rows.join(sizes.select(*by, "_month", from_.alias("_from")), [*by, "_month"]).withColumn("_n", F.col("_from") + F.col("_i"))
    return rows.withColumn("_block", F.expr(f"_n div {block or BLOCK}")).drop("_month", "_i", "_from")


def plain(rows: DataFrame) -> DataFrame:
    """Numbered rows without the helper columns."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def before(rows: DataFrame, by: Sequence[str] = BY, **columns: str) -> DataFrame:
    """Numbered rows with, as each key, the value that a column has at the bar before."""
    own = Window.partitionBy(*by, "_block").orderBy("_n")
    last = rows.groupBy(*by, "_block").agg(F.max_by(F.struct(*columns.values()), "_n").alias("_last"))
    rows = rows.join(last.withColumn("_block", F.col("_block") + 1), [*by, "_block"], "left")
    first = F.row_number().over(own) == 1
    return rows.withColumns({new: F.when(first, F.col(f"_last.{old}")).otherwise(F.lag(old).over(own)) for new, old in columns.items()}).drop("_last")


def gathered(rows: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """A row a block: ``_bars``, its rows in order."""
    rest = [c for c in rows.columns if c not in (*by, "_block", "_n")]
    return rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list(F.struct("_n", *rest))).alias("_bars"))


def smoothed(rows: DataFrame, by: Sequence[str] = BY, block: int | None = None, **averages: tuple) -> DataFrame:
    """Numbered rows with, as each key, the recursive average of (column, n, alpha, skip): seeded by the mean of the first ``n``
    bars after ``skip`` bars, null before, then moving by ``alpha`` of the distance. A null among the averaged values makes all
    later averages null."""
    names = list(averages)
    maps = {}
    for i, (column, n, alpha, skip) in enumerate(averages.values()):
        place = F.col("_n") - skip
        maps[f"_a{i}"] = F.when(place < n, 1.0).otherwise(1.0 - alpha)
        maps[f"_b{i}"] = F.when(place < 0, 0.0).when(place < n, F.col(column) / n).otherwise(F.col(column) * alpha)
    held = kept(gathered(rows.withColumns(maps), by))  # read twice; chained averages would else double all work before them

    def composed(items: Column, i: int, a, b) -> Column:
        nothing = F.struct(*[F.when(F.size(items) >= 0, v).alias(c) for c, v in (("a", 1.0), ("b", 0.0))])  # of a type that may be null
        return F.aggregate(items, nothing, lambda s, x: F.struct((a(x) * s["a"]).alias("a"), (a(x) * s["b"] + b(x)).alias("b"))).alias(f"_m{i}")

    def carried(items: Column, start: Column, a, b) -> Column:
        """The value before each item, and after the last."""
        return F.aggregate(items, F.array(F.when(F.size(items) >= 0, start)), lambda seen, x: F.array_append(seen, a(x) * F.element_at(seen, -1) + b(x)))

    every = range(len(names))
    of_map = [(lambda x, i=i: x[f"_m{i}"]["a"], lambda x, i=i: x[f"_m{i}"]["b"]) for i in every]
    of_bar = [(lambda x, i=i: x[f"_a{i}"], lambda x, i=i: x[f"_b{i}"]) for i in every]
    by_block = F.array_sort(F.collect_list(F.struct("_block", *[f"_m{i}" for i in every]))).alias("_items")
    blocks = held.select(*by, "_block", *[composed(F.col("_bars"), i, *of_bar[i]) for i in every])
    lists = blocks.groupBy(*by, F.expr(f"_block div {block or BLOCK}").alias("_up")).agg(by_block)
    tops = lists.select(*by, F.col("_up").alias("_block"), *[composed(F.col("_items"), i, *of_map[i]) for i in every]).groupBy(*by).agg(by_block)

    def down(lists: DataFrame, starts: list[Column], name: str) -> DataFrame:
        """The value carried into each item of a list."""
        lists = lists.withColumns({f"_s{i}": carried(F.col("_items"), starts[i], *of_map[i]) for i in every})
        entry = lambda x, k: F.struct(x["_block"].alias(name), *[F.get(F.col(f"_s{i}"), k).alias(f"_c{i}") for i in every])
        return lists.select(*by, F.inline(F.transform("_items", entry)))

    above = down(tops, [F.lit(0.0) for _ in every], "_up")
    into = down(lists.join(above, [*by, "_up"]).drop("_up"), [F.col(f"_c{i}") for i in every], "_block")
    held = held.join(into, [*by, "_block"]).withColumns({f"_s{i}": carried(F.col("_bars"), F.col(f"_c{i}"), *of_bar[i]) for i in every})

    def row(x, k):
        own = [x[c].alias(c) for c in rows.columns if c not in (*by, "_block")]
        value = lambda i, n, skip: F.when(x["_n"] - skip >= n - 1, F.get(F.col(f"_s{i}"), k + 1)).alias(names[i])
        return F.struct(*own, *[value(i, n, skip) for i, (_, n, _, skip) in enumerate(averages.values())])

    return held.select(*by, "_block", F.inline(F.transform("_bars", row)))


def machine(rows: DataFrame, state: str, step, by: Sequence[str] = BY) -> DataFrame:
    """Numbered rows with ``_state``, the state after each bar: ``step(state, bar)`` gives it from the one before, which is null
    before the first bar. ``state`` is its type, as DDL."""
    held = kept(gathered(rows, by))
    nothing = F.lit(None).cast(state)
    typed = lambda s, x: step(s, x).cast(state)
    ends = kept(held.select(*by, "_block", nothing.alias("start"), F.aggregate("_bars", nothing, typed).alias("end")))
    while True:
        begin = F.lag("end").over(Window.partitionBy(*by).orderBy("_block"))
        wrong = ends.withColumn("begin", begin).where(~F.col("start").eqNullSafe(F.col("begin"))).select(*by, "_block", "begin")
        wrong = kept(wrong)
        if wrong.isEmpty():
            break
        again = held.join(wrong, [*by, "_block"]).select(*by, "_block", "begin", F.aggregate("_bars", F.col("begin"), typed).alias("after"), F.lit(True).alias("again"))
        pick = lambda new, old: F.when(F.col("again"), F.col(new)).otherwise(F.col(old)).alias(old)
        ends = kept(ends.join(again, [*by, "_block"], "left").select(*by, "_block", pick("begin", "start"), pick("after", "end")))
    states = F.aggregate("_bars", F.array("start"), lambda seen, x: F.array_append(seen, typed(F.element_at(seen, -1), x)))
    own = [c for c in rows.columns if c not in (*by, "_block")]
    row = lambda x, k: F.struct(*[x[c].alias(c) for c in own], F.get(F.col("_states"), k + 1).alias("_state"))
    return held.join(ends, [*by, "_block"]).withColumn("_states", states).select(*by, "_block", F.inline(F.transform("_bars", row)))
