"""Helpers shared by the training-data operators: tables, shared folders, whole-frame identities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its rows, that is ever broadcast by hand; larger sides take a shuffled join.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch on its way to or from Python, about, where the session sets none.
BATCH_BYTES = 4 << 20
#: Most keys that ``spread_join`` takes for hot, which bounds what it broadcasts.
HOT_KEYS = 10_000
#: Links that one task of the union-find takes, so that few links don't make many small files.
TASK_EDGES = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where that is unset, a local session (one machine, as in
    tests) takes a temporary one, and any other is refused, as executors wouldn't see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="candlespark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder: survives lost executors, cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def narrow_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by ``BATCH_BYTES``, unless it has a bound of its own: 10,000 documents, Spark's
    bound, make batches of tens of MB, which the JVM and the Python worker of each task hold several times."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row in a broadcast table, about: 8 a column, 32 a text or binary (digests, keys), and 24 for the row."""
    return 24 + sum(32 if f.dataType.simpleString() in ("string", "binary") else 8 for f in df.schema.fields)


def small(df: DataFrame, rows: int | None = None, bound: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (of numbers, digests and keys) marked for broadcast if its counted rows times their bytes stay under
    ``bound``, else as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes(df) <= bound else df


def spread_join(rows: DataFrame, facts: DataFrame, key: str | list[str], weight: str) -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key; ``weight``: how many rows have it), where no task gets all rows of
    a frequent key: keys with more than one in HOT_KEYS of all rows, of which there can't be more than HOT_KEYS, are looked
    up in a broadcast table, the others join by shuffling. ``rows`` are read twice."""
    facts = cut(facts)
    total = facts.agg(F.sum(weight)).first()[0] or 0
    often = F.col(weight) > max(total // HOT_KEYS, 1)
    hot = F.broadcast(facts.where(often))
    rest = rows.join(F.broadcast(facts.where(often).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(facts.where(~often), key)).drop(weight)


def salted_join(rows: DataFrame, wide: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``wide`` (one row a key, too wide to broadcast), where no task gets all rows of a frequent
    key: such a key's rows are dealt by ``by`` to several parts, and its wide row is copied to each; these copies are at
    most twice HOT_KEYS. ``rows`` are read twice."""
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("_m")))
    part = max((counts.agg(F.sum("_m")).first()[0] or 0) // HOT_KEYS, 1)
    hot = F.broadcast(counts.where(F.col("_m") > part).select(key, F.ceil(F.col("_m") / F.lit(part)).cast("int").alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = wide.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def slices(batches: Iterable, rows: int = 500) -> Iterator:
    """Arrow batches cut into parts of at most ``rows`` rows, so that what a task derives from texts stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def doc_key(df: DataFrame) -> Column:
    """crc32 of doc_id as text, as unsigned long; null ids hash as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected links: ``(id, component)`` with the smallest id reachable.

    Distributed union-find by alternating large-star and small-star steps; every step is two aggregations
    and two shuffled joins, and its result is checkpointed, so neither links nor components ever meet on the
    driver or in one task. Ids that have no link don't appear. Self links are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = cut(e.distinct())
    parts = max(1, -(-e.count() // TASK_EDGES))
    for _ in range(max_rounds):
        e = e.coalesce(parts)
        facts = e.agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        if facts["n"] == facts["d"] and e.select("v").join(e.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty():
            break  # every id has one partner, and that is nobody's larger one
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small_star.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(parts).distinct().coalesce(parts))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
