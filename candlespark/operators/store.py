"""The stored candles: a table that several jobs may write and read at once.

Data files never change. A version is one small file that lists, for each (timeframe, month), the folder that holds it; the newest
version is the table. A writer merges its rows with the months they touch, writes these to a folder of its own, and makes the next
version by creating its file with its content, all at once, if nobody has; else it starts again from what others made, without
writing anew where they touched other months. So no write is lost, none is seen by half, and a reader keeps the version that
it began with.

    store.upsert(candles, path)
    store.read(spark, path, timeframe="5m", months=["2024-01"])

Defined cases: rows without a time are refused, timeframes that are made on reading too; no rows make no version; a key that
comes twice in one call is the caller's error (folds give each key once); a table that nobody wrote is empty; a failed job
leaves its files unlisted, ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.operators.fold import check_stored
from candlespark.operators.upsert import CANDLE_KEY, upsert_candles
from candlespark.schemas import CANDLE

#: Files that a month is dealt to, and attempts to make a version before giving up.
FILES, ATTEMPTS = 8, 50


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store its path names."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with its content in one step, or tells that it is there. Local files are linked, elsewhere renamed to their name,
    which a store must refuse where the name is taken (HDFS does)."""
    fs, at = _at(spark, path)
    _, draft = _at(spark, f"{path}-{uuid.uuid4().hex}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            files, local = spark._jvm.java.nio.file.Files, lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
            try:
                files.createLink(local(at), local(draft))
                return True
            except Exception as e:
                if "FileAlreadyExistsException" in str(e):
                    return False
                raise
        return not fs.exists(at) and fs.rename(draft, at)
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions that are kept, oldest first."""
    fs, at = _at(spark, f"{path.rstrip('/')}/_versions")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def _name(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/_versions/{version:020d}.json"


def listing(spark: SparkSession, path: str, version: int) -> dict[tuple[str, str], str]:
    """The folder of each (timeframe, month) of a version; version 0 is empty."""
    if not version:
        return {}
    fs, at = _at(spark, _name(path, version))
    source = fs.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return {(tf, month): folder for tf, month, folder in json.loads(text)}


def latest(spark: SparkSession, path: str) -> int:
    """The newest version, 0 where there is none."""
    return max(versions(spark, path), default=0)


def _rows(spark: SparkSession, path: str, folders: Iterable[str]) -> DataFrame:
    found = [f"{path.rstrip('/')}/{f}" for f in folders]
    return spark.read.schema(CANDLE).parquet(*found) if found else spark.createDataFrame([], CANDLE)


def read(spark: SparkSession, path: str, version: int | None = None, timeframe: str | None = None, months: Iterable[str] | None = None) -> DataFrame:
    """The candles of a version (the newest, if none is told), of one timeframe and of some months (yyyy-MM) where these are told:
    other folders aren't opened."""
    months = None if months is None else set(months)
    at = latest(spark, path) if version is None else version
    return _rows(spark, path, [f for (tf, m), f in listing(spark, path, at).items() if timeframe in (None, tf) and (months is None or m in months)])


def upsert(new: DataFrame, path: str, key: Sequence[str] = CANDLE_KEY) -> int:
    """Upserts candles, and tells the version that holds them. Only the months that ``new`` touches are read and written. The list of
    months is all that comes to the driver."""
    spark, path = new.sparkSession, path.rstrip("/")
    month = F.date_format("ts", "yyyy-MM")
    staged, written = f"{path}/_staged/{uuid.uuid4().hex}", None
    try:
        new.select(CANDLE.names).write.parquet(staged)  # once: a conflict merges the same rows again
        rows = spark.read.schema(CANDLE).parquet(staged)
        touched = [(check_stored(r.timeframe), r.month) for r in rows.select("timeframe", month.alias("month")).distinct().collect()]
        if any(m is None for _, m in touched):
            raise ValueError("a candle without a time")
        if not touched:
            return latest(spark, path)
        merged_from = None
        for attempt in range(ATTEMPTS):
            base = latest(spark, path)
            held = listing(spark, path, base)
            mine = {t: held.get(t) for t in touched}
            if mine != merged_from:
                if written:
                    remove(spark, f"{path}/{written}")
                written, merged_from = f"data/{uuid.uuid4().hex}", mine
                merged = upsert_candles(_rows(spark, path, [f for f in mine.values() if f]), rows, key).select(CANDLE.names)
                merged = merged.withColumns({"_tf": F.col("timeframe"), "_month": month})
                dealt = merged.repartition("_tf", "_month", F.pmod(F.xxhash64("symbol_id"), F.lit(FILES))).sortWithinPartitions("_tf", "_month", "symbol_id", "ts")
                dealt.write.partitionBy("_tf", "_month").parquet(f"{path}/{written}")
            after = held | {(tf, m): f"{written}/_tf={tf}/_month={m}" for tf, m in touched}
            if create_once(spark, _name(path, base + 1), json.dumps([[tf, m, f] for (tf, m), f in sorted(after.items())])):
                written = None
                return base + 1
            time.sleep(random.random() * 0.05 * 2 ** min(attempt, 6))
        raise RuntimeError(f"no version of {path} could be made in {ATTEMPTS} attempts")
    finally:
        remove(spark, staged)
        if written:
            remove(spark, f"{path}/{written}")


def vacuum(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> int:
    """Deletes all but the newest ``keep`` versions, and the folders that none of these lists and that are older than ``hours`` (a
    younger one may belong to a writer at work, an older version to a reader). Tells how many folders went."""
    path = path.rstrip("/")
    there = versions(spark, path)
    stay, go = there[-max(keep, 1) :], there[: -max(keep, 1)]
    used = {f.split("/")[1] for v in stay for f in listing(spark, path, v).values()}
    before, gone = time.time() * 1000 - hours * 3_600_000, 0
    for v in go:
        remove(spark, _name(path, v))
    for folder in ("data", "_staged"):
        fs, at = _at(spark, f"{path}/{folder}")
        for status in fs.listStatus(at) if fs.exists(at) else []:
            if status.getPath().getName() not in used and status.getModificationTime() <= before:
                gone += fs.delete(status.getPath(), True)
    return gone
