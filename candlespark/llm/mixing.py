"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target, its total demand of words, and a weight schedule over training time 0..1 (linear
between knots). The schedule's integral, scaled to the target, is the source's cumulative demand. The documents
of a source stand in a fixed pseudo-random order; a document's place in the running sum of sizes, put through
the inverse of the cumulative demand, is its training position, and the mix is the documents range-sorted by
position. Where a target exceeds the source's size, the order starts over: a document can come again.

The running sums are two-level: sizes are added per (source, bucket of the order), bucket sums are accumulated
per source, and a window inside (source, bucket) gives the rest; so a source with a third of all rows is spread
over all its buckets.

Defined cases: null text has size 0; null source is a source of its own, ordered last; documents of a source
without any words are taken once (they add nothing); rows that are equal in doc_id and size may change places
with one another, which changes no result; an empty table gives an empty mix; other columns are carried
through ``mix`` and ignored by ``assign``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, small, table, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Knots of training time, and the course of a source's weight at them by its place in WEIGHTS.
TIMES = (0.0, 0.5, 1.0)
COURSES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
#: Buckets of a source's order, by the first three hexadecimal digits of a digest.
DIGITS = 3
#: Columns added while working; free of clashes with documents' own.
S, K, B, D = "_mix_size", "_mix_source", "_mix_bucket", "_mix_digest"


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source key (null is a key of its own), order digest and bucket. Rows without an id are ordered by their
    text, so that they don't fall into one bucket."""
    own = F.concat(F.lit("text "), F.md5(text_of().cast("binary")))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), own).cast("binary"))
    source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), "source"))
    out = docs.withColumn(S, words(text_of())).withColumn(K, source).withColumn(D, digest)
    return out.withColumn(B, F.substring(D, 1, DIGITS))


def targets(sums: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MAX_REPEATS) -> DataFrame:
    """``sums(source key, size)`` to one row per source: rank, weight, size, target.

    Targets are a common rate times the weight, stopped at ``most`` times the source's size, with the rate such
    that they add up to ``share`` of all sizes: sources in order of cap over weight are stopped one after the
    other until the rate left for the rest stops no further one. Sources are a dimension table, so their
    windows run in one task.
    """
    of_all, by_name = Window.partitionBy(), Window.orderBy(F.col(K) == "n", K)
    rank = (F.row_number().over(by_name) - 1).cast("int")
    t = sums.withColumn("rank", rank).withColumn("place", F.col("rank") % len(weights))
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(most))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(of_all) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rate = left / (F.sum("weight").over(of_all) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    t = t.withColumn("rate", rate)
    settled = F.min(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "rate"))).over(of_all)
    t = t.withColumn("rate", settled["rate"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap").cast("double")))
    return t.select(K, "rank", "place", "source_size", target.alias("target"))


def course(place: Column, times: Sequence[float] = TIMES, courses: Sequence[Sequence[float]] = COURSES) -> Column:
    """Array of (time, weight, width, slope, integral before) per stretch of the schedule, whose whole integral is 1."""
    rows = []
    for shape in courses:
        whole = sum((a + b) / 2 * (t1 - t0) for t0, t1, a, b in zip(times, times[1:], shape, shape[1:]))
        done, parts = 0.0, []
        for t0, t1, a, b in zip(times, times[1:], shape, shape[1:]):
            a, b = a / whole, b / whole
            parts.append(F.struct(*[F.lit(float(v)).alias(n) for n, v in (("t", t0), ("w", a), ("dt", t1 - t0), ("slope", (b - a) / (t1 - t0)), ("done", done))]))
            done += (a + b) / 2 * (t1 - t0)
        rows.append(F.array(*parts))
    return F.element_at(F.array(*rows), place + 1)


def position(u: Column, stretches: Column) -> Column:
    """Inverse of the schedule's integral: the time at which the share ``u`` of the demand is met."""
    at = F.element_at(F.filter(stretches, lambda s: s["done"] <= u), -1)
    rest = u - at["done"]
    root = F.sqrt(F.greatest(at["w"] * at["w"] + 2 * at["slope"] * rest, F.lit(0.0)))
    return at["t"] + F.least(at["dt"], F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (at["w"] + root)))


def assign(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_REPEATS, times=TIMES, courses=COURSES) -> DataFrame:
    """doc_id and source of ``docs(doc_id, source, text, ...)``, with size, source_size, target, copies (times taken)
    and positions (array, one per copy). Other columns are left out, whatever their names."""
    return placed(keyed(docs.select("doc_id", "source", "text")).drop("text"), weights, share, most, times, courses)


def placed(rows: DataFrame, weights, share, most, times, courses) -> DataFrame:
    """``assign`` over rows that ``keyed`` has made; further columns are carried along."""
    sums = rows.groupBy(K, B).agg(F.sum(S).alias("bucket_size"))
    per_source = targets(sums.groupBy(K).agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    before = Window.partitionBy(K).orderBy(B).rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))).drop("bucket_size")
    buckets = small(cut(buckets.join(small(cut(per_source)), K)))
    within = Window.partitionBy(K, B).orderBy(D, "doc_id", S).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_mix_start", F.coalesce(F.sum(S).over(within), F.lit(0))).join(buckets, [K, B])
    middle = F.col("bucket_start") + F.col("_mix_start") + F.col(S) / F.lit(2)
    passes = F.ceil((F.col("target") - middle) / F.col("source_size"))
    copies = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.least(F.greatest(passes, F.lit(0)), F.lit(most)))
    rows = rows.withColumn("_mix_middle", middle).withColumn("copies", copies.cast("long"))
    share_of = lambda k: F.coalesce(F.try_divide(F.col("_mix_middle") + k * F.col("source_size"), F.col("target")), F.lit(0.0))
    places = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: position(share_of(k - 1), course(F.col("place"), times, courses)))
    places = F.when(F.col("copies") > 0, places).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("positions", places).withColumnRenamed(S, "size").drop(K, B, D, "_mix_start", "_mix_middle", "bucket_start", "rank", "place")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The mixed documents themselves: columns of ``docs``, a row per copy, range-sorted by training position."""
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])  # clashing names
    named = plain.withColumn("doc_id", plain[f"c{own.index('doc_id')}"]).withColumn("source", plain[f"c{own.index('source')}"])
    named = named.withColumn("text", plain[f"c{own.index('text')}"]).drop(f"c{own.index('text')}")
    known = {"weights": WEIGHTS, "share": SHARE, "most": MAX_REPEATS, "times": TIMES, "courses": COURSES} | parameters
    taken = placed(keyed(named), **known).where("copies > 0")
    columns = ["text" if c == "text" else f"c{i}" for i, c in enumerate(own)]
    out = taken.select(*columns, F.explode("positions").alias("position"))
    out = out.repartitionByRange(F.col("position"), F.col(f"c{own.index('doc_id')}")).sortWithinPartitions("position", f"c{own.index('doc_id')}")
    return out.select(*columns).toDF(*own)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, in order of first training position (those not taken last)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = assign(docs)
    first = F.coalesce(F.try_element_at("positions", F.lit(1)), F.lit(2.0))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), first.alias("first"))
    return out.repartitionByRange(F.col("first"), F.col("doc_id")).sortWithinPartitions("first", "doc_id").drop("first")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS digest
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rk
  FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2 AS cap FROM s),
r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(cap) OVER o, 0) AS DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS rate
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rate, CAST(cap AS DOUBLE) / weight * 1e6 + rk) AS rate FROM r WHERE rate * weight <= cap),
t AS (
  SELECT r.source, r.source_size,
         least(CAST(r.cap AS DOUBLE), coalesce(f.rate * r.weight, CAST(r.cap AS DOUBLE))) AS target
  FROM r LEFT JOIN f ON true),
c AS (
  SELECT d.*, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) + size / 2.0::DOUBLE AS middle
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 1
            ELSE least(greatest(ceil((target - middle) / source_size), 0), 2) END * size AS BIGINT) AS taken
FROM c
"""
