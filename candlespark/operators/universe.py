"""The symbol universe: search, admission plan, stale symbols, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.functions.tickers import classify, default_lot, default_tick, normal, reachable
from candlespark.operators.upsert import deactivate, upsert_symbols
from candlespark.schemas import CURRENCY, SYMBOLS_DEFAULT, SYMBOLS_MAX


def hit(query: str, text: Column) -> Column:
    """Place of the query's literal text, upper-cased, in ``text``; 0 where it isn't."""
    return F.instr(text, F.lit(query.upper()))


def search(symbols: DataFrame, query: str = "", kind: str = "", limit: int | None = None) -> DataFrame:
    """Symbols whose ticker or long name holds the query (all for an empty one), best hits first."""
    limit = max(1, min(limit or SYMBOLS_DEFAULT, SYMBOLS_MAX))
    rows = symbols if not kind else symbols.where(F.col("kind") == kind)
    in_ticker, in_name = hit(query, F.col("ticker")), hit(query, F.upper("long_name"))
    if query:
        rows = rows.where((in_ticker > 0) | (in_name > 0))
    return rows.orderBy(F.desc(in_ticker == 1), F.desc(in_ticker > 0), F.desc("tracked"), F.desc("active"), F.asc("ticker")).limit(limit)


def symbol_of(symbols: DataFrame, ticker: str) -> DataFrame:
    """The one row of a ticker (unique); LookupError where there is none."""
    name = (ticker or "").strip().upper()
    found = symbols.where(F.col("ticker") == name)
    if found.isEmpty():
        raise LookupError(f"{name!r} is not among the symbols")
    return found


def listing(symbols: DataFrame, tracked: bool = False) -> DataFrame:
    """All symbols, or the tracked ones, by ticker."""
    return (symbols.where("tracked") if tracked else symbols).orderBy("ticker")


def candles_of(candles: DataFrame, symbols: DataFrame, ticker: str) -> DataFrame:
    """Stored candles (by symbol_id) of a ticker, with it in ``symbol``. The ticker's one row is what is joined, so the
    candle side is filtered by a broadcast of a single row."""
    one = symbol_of(symbols, ticker).limit(1).select(F.col("id").alias("symbol_id"), F.col("ticker").alias("symbol"))
    return candles.join(F.broadcast(one), "symbol_id")


def resolve(symbols: DataFrame, tickers: str | None = None) -> DataFrame:
    """The symbols that a job works on: those of a comma list, each of which must be known, or (without a list) all
    tracked ones but futures, of which there must be some."""
    if tickers is None:
        found = symbols.where("tracked AND kind <> 'future'").orderBy("ticker")
        if found.isEmpty():
            raise LookupError("no symbol is tracked; admit some first")
        return found
    names = [t for t in (x.strip().upper() for x in tickers.split(",")) if t]
    if not names:
        raise ValueError("name tickers, as in PETR4,VALE3, or take the universe")
    found = symbols.where(F.col("ticker").isin(*names))
    missing = set(names) - {r.ticker for r in found.select("ticker").collect()}  # as many rows as tickers were named
    if missing:
        raise LookupError(f"not among the symbols: {' '.join(sorted(missing))}")
    return found


def enrichable(symbols: DataFrame, has_token: bool) -> DataFrame:
    """Symbols that the provider can be asked about: no futures, and without a token only the free tickers."""
    return symbols.where((F.coalesce("kind", F.lit("")) != "future") & reachable(F.col("ticker"), has_token))


def newest_lists(lists: DataFrame) -> DataFrame:
    """Index compositions (index, year, month, tickers): the newest per index."""
    w = Window.partitionBy("index").orderBy(F.desc("year"), F.desc("month"))
    return lists.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def union_tickers(lists: DataFrame) -> DataFrame:
    """Distinct tickers of all lists, in order."""
    return lists.select(F.explode("tickers").alias("t")).select(normal(F.col("t")).alias("ticker")).distinct().orderBy("ticker")


def unclassified(tickers: DataFrame) -> DataFrame:
    """Tickers of no known shape; a plan refuses them."""
    return tickers.where(classify(F.col("ticker")).isNull()).select("ticker")


def desired(admitted: DataFrame, futures: DataFrame, seeds: DataFrame) -> DataFrame:
    """Symbols wanted from admission lists (ticker), futures (root, name, long_name, point_value, tick_size,
    lot_size) and seeds (ticker, kind, names, currency, sizes, tracked); a seed's non-empty fields win, and a seed
    that changes the kind first resets lot and tick size to that kind's."""
    kind = classify(F.col("ticker"))
    null = lambda t: F.lit(None).cast(t)
    listed = admitted.select("ticker").distinct().select(
        "ticker", null("string").alias("short_name"), null("string").alias("long_name"), kind.alias("kind"), default_lot(kind).alias("lot_size"), default_tick(kind).alias("tick_size"), null("double").alias("point_value"), F.lit(True).alias("tracked"), F.lit(0).alias("rank")
    )
    contracts = futures.select(
        F.col("root").alias("ticker"), F.col("name").alias("short_name"), "long_name", F.lit("future").alias("kind"), F.col("lot_size").cast("int"), F.col("tick_size").cast("double"), F.col("point_value").cast("double"), F.lit(False).alias("tracked"), F.lit(1).alias("rank")
    )
    both = listed.unionByName(contracts)
    fields = ["short_name", "long_name", "kind", "lot_size", "tick_size", "point_value"]
    first = both.groupBy("ticker").agg(F.bool_or("tracked").alias("tracked"), F.min_by(F.struct(*fields), "rank").alias("s")).select("ticker", "tracked", "s.*")
    s = seeds.select("ticker", *[F.col(c).alias(f"seed_{c}") for c in ("kind", "short_name", "long_name", "currency", "lot_size", "tick_size", "point_value", "tracked")])
    rows = first.join(s, "ticker", "full")
    own = F.coalesce("kind", classify(F.col("ticker")))
    said = F.nullif(F.lower(F.trim("seed_kind")), F.lit(""))
    kind_now = F.coalesce(said, own)
    reset = own.isNull() | F.col("kind").isNull() | (kind_now != own)
    text = lambda c: F.coalesce(F.nullif(F.col(f"seed_{c}"), F.lit("")), F.col(c))
    return rows.select(
        "ticker", text("short_name").alias("short_name"), text("long_name").alias("long_name"), kind_now.alias("kind"),
        F.coalesce(F.nullif("seed_currency", F.lit("")), F.lit(CURRENCY)).alias("currency"),
        F.coalesce("seed_lot_size", F.when(reset, default_lot(kind_now)).otherwise(F.col("lot_size"))).cast("int").alias("lot_size"),
        F.coalesce("seed_tick_size", F.when(reset, default_tick(kind_now)).otherwise(F.col("tick_size"))).alias("tick_size"),
        F.coalesce("seed_point_value", "point_value").alias("point_value"),
        (F.coalesce("tracked", F.lit(False)) | F.coalesce("seed_tracked", F.lit(False))).alias("tracked"),
    )


def admission(desired_: DataFrame, existing: DataFrame) -> DataFrame:
    """Desired symbols with created (unknown so far) and admitted (tracked now, not before)."""
    known = existing.select("ticker", F.col("tracked").alias("_before"), F.lit(True).alias("_known"))
    rows = desired_.join(known, "ticker", "left")
    created = F.col("_known").isNull()
    return rows.withColumn("created", created).withColumn("admitted", F.col("tracked") & ~F.coalesce("_before", F.lit(False))).drop("_before", "_known")


def departures(existing: DataFrame, admitted: DataFrame, desired_: DataFrame) -> DataFrame:
    """Tracked symbols that neither a list nor a tracked desired symbol names any more."""
    rows = existing.where("tracked").join(admitted.select("ticker").distinct(), "ticker", "left_anti")
    return rows.join(desired_.where("tracked").select("ticker"), "ticker", "left_anti").select("ticker").orderBy("ticker")


def stale(existing: DataFrame, available: DataFrame, check: bool = True) -> DataFrame:
    """Active symbols other than futures that the provider doesn't list; refuses an empty provider list."""
    listed = available.select(normal(F.col("ticker")).alias("ticker")).distinct()
    if check and listed.isEmpty():
        raise ValueError("the provider lists no symbols")
    return existing.where("active AND kind <> 'future'").join(listed, "ticker", "left_anti").select("ticker")


def enrich(symbols: DataFrame, quotes: DataFrame, has_token: bool = True) -> DataFrame:
    """Non-empty names and currency of a quote win over a symbol's own; only ``enrichable`` symbols change."""
    q = quotes.select(normal(F.col("symbol")).alias("ticker"), F.col("shortName").alias("_s"), F.col("longName").alias("_l"), F.col("currency").alias("_c"))
    q = q.dropDuplicates(["ticker"]).join(enrichable(symbols, has_token).select("ticker"), "ticker", "left_semi")
    rows = symbols.join(q, "ticker", "left")
    for own, new in (("short_name", "_s"), ("long_name", "_l"), ("currency", "_c")):
        rows = rows.withColumn(own, F.coalesce(F.nullif(F.trim(new), F.lit("")), F.col(own)))
    return rows.drop("_s", "_l", "_c")


def sync(existing: DataFrame, admitted: DataFrame, futures: DataFrame, seeds: DataFrame, today, quotes: DataFrame | None = None, available: DataFrame | None = None, has_token: bool = True) -> tuple[DataFrame, DataFrame]:
    """The symbol table after a sync, and the plan's rows (``ticker`` and one flag a change: created, admitted,
    departed, deactivated). ``quotes`` enrich the desired symbols, and with ``available`` active symbols that the provider
    no longer lists are deactivated. A dry run reads the plan only; nothing is written here.
    """
    wanted = desired(admitted, futures, seeds)
    plan = admission(wanted, existing).select("ticker", "created", "admitted")
    gone = departures(existing, admitted, wanted).withColumn("departed", F.lit(True))
    day = F.lit(str(today)).cast("date")
    rows = wanted if quotes is None else enrich(wanted, quotes, has_token)
    new = rows.select(*[c for c in existing.columns if c in rows.columns], F.lit(True).alias("active"), day.alias("first_seen"), day.alias("last_seen"))
    after = upsert_symbols(existing, new.select(*[c for c in existing.columns if c != "id"]))
    out = existing.where(F.lit(False)).select("ticker") if available is None else stale(existing, available)
    marked = deactivate(after, out)
    flags = plan.join(gone, "ticker", "full").join(marked.where("changed").select("ticker", F.lit(True).alias("deactivated")), "ticker", "full")
    return marked.drop("changed"), flags.select("ticker", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("created", "admitted", "departed", "deactivated")])


def sync_report(plan: DataFrame, shown: int = 20) -> DataFrame:
    """One row over a sync's plan: per kind of change its count and the first tickers."""
    place = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("ticker"))
    names = ("created", "admitted", "departed", "deactivated")
    rows = plan.select("ticker", *names, *[place(c).alias(f"_{c}") for c in names])  # one row a symbol: a dimension
    first = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) & (F.col(f"_{c}") <= shown), F.col("ticker"))))
    return rows.agg(*[F.count_if(F.col(c)).alias(c) for c in names], *[first(c).alias(f"{c}_tickers") for c in names])


def chunks(tickers: DataFrame, size: int) -> DataFrame:
    """Tickers in requests of ``size``."""
    place = F.row_number().over(Window.orderBy("ticker"))
    return tickers.withColumn("chunk", F.floor((place - 1) / F.lit(size)).cast("int"))
