"""Configuration sources: calendar, contracts with seeds, index compositions. Unknown fields and broken rules fail."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlespark.functions.calendar import minutes
from candlespark.functions.tickers import months_ok, normal
from candlespark.schemas import KINDS

# The fields of the calendar, contract and index files, and the name that an index file has.
CALENDAR = "timezone string, session struct<open: string, close: string>, holidays array<struct<date: string, name: string, open: string, close: string>>"
CONTRACTS = (
    "futures array<struct<root: string, name: string, long_name: string, point_value: double, tick_size: double, lot_size: int, months: string>>, "
    "symbols array<struct<ticker: string, kind: string, short_name: string, long_name: string, currency: string, lot_size: int, tick_size: double, point_value: double, tracked: boolean>>"
)
INDEX = "index string, as_of string, source string, tickers array<string>"
INDEX_FILE = r"^(.+)-(\d{4})-(\d{2})\.json$"


def names(schema: T.DataType, prefix: str = "") -> set[str]:
    """All field paths of a type."""
    if isinstance(schema, T.ArrayType):
        return names(schema.elementType, prefix)
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in {prefix + f.name} | names(f.dataType, prefix + f.name + ".")}
    return set()


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a fixed schema; broken JSON and fields beyond the schema are errors."""
    found = spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
    extra = names(found.schema) - names(T.StructType.fromDDL(schema))
    if extra:
        raise ValueError(f"unknown fields {sorted(extra)} in {path}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def refuse(rows: DataFrame, rules: dict, what: str) -> None:
    """ValueError for the first rows that break one of ``rules`` (message to condition of being wrong)."""
    reason = F.coalesce(*[F.when(F.coalesce(c, F.lit(True)), F.lit(m)) for m, c in rules.items()])
    bad = rows.withColumn("_why", reason).where("_why IS NOT NULL").limit(3).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(f"{r['_why']} ({r[0]})" for r in bad))


def repeats(rows: DataFrame, key: str, what: str) -> None:
    """ValueError where a key comes twice."""
    bad = rows.groupBy(key).count().where("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"{what}: repeated {key} {', '.join(str(r[0]) for r in bad)}")


def calendar(spark: SparkSession, path: str) -> tuple[str, str, str, DataFrame]:
    """Zone, usual open and close, and holidays (day, name, open, close) of a calendar file."""
    from zoneinfo import ZoneInfo

    doc = strict_json(spark, path, CALENDAR)
    head = doc.select("timezone", "session.open", "session.close").first()
    ZoneInfo(head["timezone"])
    spans = doc.select(minutes(F.col("session.open")).alias("a"), minutes(F.col("session.close")).alias("b")).first()
    if spans["a"] is None or spans["b"] is None or spans["b"] <= spans["a"]:
        raise ValueError("a session must close after it opens")
    rows = doc.select(F.explode("holidays").alias("h")).select(F.to_date("h.date", "yyyy-MM-dd").alias("day"), "h.name", "h.open", "h.close")
    if rows.isEmpty():
        raise ValueError("a calendar needs holidays")
    usual = lambda c, d: minutes(F.coalesce(F.col(c), F.lit(d)))
    refuse(rows, {"date missing": F.col("day").isNull(), "name missing": F.trim(F.coalesce("name", F.lit(""))) == "", "closes before it opens": usual("close", head["close"]) <= usual("open", head["open"])}, "calendar")
    repeats(rows, "day", "calendar")
    return head["timezone"], head["open"], head["close"], rows


def contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Futures and symbol seeds of a contracts file."""
    doc = strict_json(spark, path, CONTRACTS)
    futures, seeds = doc.select(F.inline("futures")), doc.select(F.inline("symbols"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    refuse(futures, {"root missing": blank("root"), "point value not positive": F.col("point_value") <= 0, "tick size not positive": F.col("tick_size") <= 0, "lot size not positive": F.col("lot_size") <= 0, "bad month codes": ~months_ok(F.col("months"))}, "futures")
    repeats(futures, "root", "futures")
    null_or = lambda c: F.coalesce(F.col(c) <= 0, F.lit(False))
    refuse(seeds, {"ticker missing": blank("ticker"), "unknown kind": ~(blank("kind") | F.lower(F.trim("kind")).isin(*KINDS)), "lot size not positive": null_or("lot_size"), "tick size not positive": null_or("tick_size"), "point value not positive": null_or("point_value")}, "symbols")
    repeats(seeds, "ticker", "symbols")
    return futures, seeds.withColumn("ticker", normal(F.col("ticker"))).withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def index_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Index compositions of a folder, newest per index: index, year, month, tickers, file."""
    from candlespark.operators.universe import newest_lists

    rows = strict_json(spark, f"{folder.rstrip('/')}/*.json", INDEX).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    part = lambda i: F.regexp_extract("file", INDEX_FILE, i)
    rows = rows.withColumn("year", part(2).try_cast("int")).withColumn("month", part(3).try_cast("int"))
    tickers = F.transform(F.coalesce("tickers", F.array().cast("array<string>")), normal)
    rows = rows.withColumn("tickers", tickers)
    refuse(rows.select("file", "*"), {
        "file name isn't <index>-<year>-<month>": ~F.col("file").rlike(INDEX_FILE), "index differs from the file name": F.lower("index") != F.lower(part(1)),
        "as_of differs from the file name": ~F.col("as_of").startswith(F.concat(part(2), F.lit("-"), part(3))), "no tickers": F.size("tickers") == 0,
        "empty ticker": F.exists("tickers", lambda t: t == ""), "repeated ticker": F.size(F.array_distinct("tickers")) != F.size("tickers"),
    }, "index lists")
    return newest_lists(rows.select("index", "year", "month", "tickers", "file"))
