"""Hard negatives: rows of another label that score just below an anchor's positives, found by one-dimensional distance keys.

The largest inner product becomes the nearest distance when every vector gets one more component, sqrt(M^2 - |x|^2), and an
anchor gets 0 there (M: the longest vector's length). Augmented vectors belong to their nearest pivot and are stored sorted by
(length, pivot, distance to the pivot), in blocks of ``BLOCK`` rows. By the triangle inequality a row is at least
|distance to its pivot - the anchor's distance to that pivot| away from an anchor, so all rows that are no farther than r lie
in one interval of keys a pivot: an annulus.

A search scans annuli of a first radius, then those up to the radius that what it found proves to be enough (its k-th row is
no nearer than that), or the radius of the lowest score asked for; it ends when the remaining distance bound certifies the
k rows. A scan meets blocks of rows with groups of ``GROUP`` anchors near one another, where their annuli reach; blocks that
no annulus of a group reaches aren't moved, a row outside an anchor's annulus isn't its candidate. Each meeting gives k rows
an anchor at most, and ranks are taken from these after a limit within each task, so no task gathers an anchor's rows.

Where vectors have no structure (independent directions in many dimensions) annuli hold nearly all rows, and a scan is the
product of all anchors with all rows in blocks; results are exact all the same.

Pivots come from a hash sample of about ``SAMPLE`` rows, the only rows that reach the driver.

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; rows of different length
have no score and never meet; repeated rows are rows of their own, so an anchor's copy is its positive; copies of an anchor
are anchors; an anchor without positives, or a positive without negatives in its band, gives no rows; scores beyond a long are
refused; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, scratch_path, slices, small, table
from candlespark.llm.embedding_dedup import by_length

#: Positives of an anchor, negatives of a positive, and the band of their scores in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows of a block, anchors of a group, pivots of a vector length, rows that they are taken from.
BLOCK, GROUP, PIVOTS, SAMPLE = 2_048, 1_024, 16, 2_000
#: Rows that a task stores, anchors that a task scores at once; slack of computed distances, in parts of the longest vector.
TASK_ROWS, AT_ONCE, SLACK = 65_536, 256, 1e-6


def prepared(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to the rows that take part: row, vec_id, label, v (whole numbers), size, square."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return rows.withColumns({"size": F.size("v"), "square": square, "row": F.monotonically_increasing_id()})


def pivots_of(sample, longest: float) -> dict:
    """Pivots per vector length from sampled vectors: some steps of k-means over augmented vectors."""
    import numpy as np

    found = {}
    for size in sorted({len(v) for v in sample}):
        own = [v for v in sample if len(v) == size]
        x = augmented(np.array(own, dtype=float).reshape(len(own), size), longest)
        p = np.unique(x, axis=0)
        p = p[:: max(1, len(p) // PIVOTS)][:PIVOTS]
        for _ in range(5):
            near = distances(x, p).argmin(axis=1)
            p = np.array([x[near == k].mean(axis=0) if (near == k).any() else p[k] for k in range(len(p))])
        found[size] = p
    return found


def augmented(x, longest: float):
    """Rows with the component that makes them all ``longest`` long."""
    import numpy as np

    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1, keepdims=True), 0))])


def distances(x, y):
    """Distances of rows to rows."""
    import numpy as np

    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0))


def pivots_for(pivots: dict, size: int):
    """The pivots of vectors of ``size`` components; the origin where none was sampled."""
    import numpy as np

    return pivots.get(size, np.zeros((1, size + 1)))


def product(a, b):
    """Inner products of rows with rows, exactly: by floating point where no sum reaches 2^53, else by integers."""
    import numpy as np

    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 2**53:
        return a @ b.T
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("a score doesn't fit in a long")


class Index:
    """The stored rows, sorted by (size, pivot, key) in blocks, and what searches need to know of them."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        rows = self._kept(prepared(vectors), "vectors")
        facts = rows.agg(F.count("*").alias("n"), F.max("square").alias("square")).first()
        self.rows, self.longest = facts["n"], (facts["square"] or 0.0) ** 0.5
        part = min(1.0, SAMPLE / max(self.rows, 1))
        sample = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(part * (1 << 30))).select("v").limit(2 * SAMPLE).collect()
        self.pivots = pivots_of([r["v"] for r in sample], self.longest)
        self.table = self._sorted(self._keyed(rows), self.rows, BLOCK, "block")
        self.spans = cut(self.table.groupBy("block", "size", "pivot").agg(F.min("key").alias("low"), F.max("key").alias("high")))

    def _kept(self, rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        rows.write.parquet(path)
        return self.spark.read.parquet(path)

    def _sorted(self, rows: DataFrame, n: int, unit: int, name: str) -> DataFrame:
        """``rows`` stored in order of (size, pivot, key), however many tasks store them, with a column ``name`` that numbers each
        ``unit`` rows of that order. A window in one task adds up the tasks' row counts."""
        tasks, order = max(self.spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)), ["size", "pivot", "key", "row"]
        stored = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
        stored = self._kept(stored, name).withColumn("task", F.shiftright("place", 33))
        sizes = stored.groupBy("task").agg(F.count("*").alias("n"))
        sizes = cut(sizes.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("from")))
        at = F.col("from") + F.col("place").bitwiseAND((1 << 33) - 1)
        return stored.join(F.broadcast(sizes), "task").withColumn(name, F.floor(at / unit)).drop("task", "place", "from")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        pivots, longest = self.pivots, self.longest

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in slices(batches, 4_096):
                pivot, key = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
                for own, x in by_length(batch.column("v")):
                    d = distances(augmented(x, longest), pivots_for(pivots, x.shape[1]))
                    pivot[own] = d.argmin(axis=1)
                    key[own] = d[np.arange(len(own)), pivot[own]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(key)], names=[*batch.schema.names, "pivot", "key"])

        return rows.mapInArrow(run, "vec_id long, label long, v array<double>, size int, square double, row long, pivot int, key double")

    def anchors(self, where) -> DataFrame:
        """The rows that are anchors, in groups of neighbours in the order of the index."""
        rows = self.table.where(where).drop("block")
        return self._sorted(rows, rows.count(), GROUP, "group").drop("pivot", "key")

    def scan(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """``anchors(row, group, label, v, size, inner, outer, bands)``: of the rows whose annulus lies beyond ``inner`` and up to
        ``outer``, the ``k`` best a band: (anchor, band, row, vec_id, score). ``same``: of the anchor's label, the anchor itself not,
        one band without bounds; else of other labels, with low <= score <= high of each band."""
        pivots, longest = self.pivots, self.longest

        def reach(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in slices(batches, 4_096):
                group, outer, inner = (batch.column(c).to_numpy() for c in ("group", "outer", "inner"))
                for own, x in by_length(batch.column("v")):
                    d = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots_for(pivots, x.shape[1]))
                    n, m = d.shape
                    low, high = d - outer[own][:, None], d + outer[own][:, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(group[own], m)), pa.array(np.full(n * m, x.shape[1], dtype=np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), n)), pa.array(low.ravel()), pa.array(high.ravel())],
                        names=["group", "size", "pivot", "least", "most"],
                    )

        def meet(key, rows, queries):
            import numpy as np
            import pyarrow as pa

            out: list = []
            order = np.lexsort([rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()])  # ties: the first is the smaller id
            rows = rows.take(pa.array(order))
            ids, labels, own_row, pivot, keys = (rows.column(c).to_numpy() for c in ("vec_id", "label", "row", "pivot", "key"))
            theirs, their_label, inner, outer = (queries.column(c).to_numpy() for c in ("row", "label", "inner", "outer"))
            bands = queries.column("bands").to_pylist()
            held = {x.shape[1]: (at, x) for at, x in by_length(rows.column("v").combine_chunks())}
            parts = ((at[k : k + AT_ONCE], x[k : k + AT_ONCE]) for at, x in by_length(queries.column("v").combine_chunks()) for k in range(0, len(at), AT_ONCE))
            for at, x in parts:
                if x.shape[1] not in held:
                    continue
                mine, y = held[x.shape[1]]
                d = distances(np.hstack([x, np.zeros((len(x), 1))]), pivots_for(pivots, x.shape[1]))
                gap = np.abs(keys[mine] - d[:, pivot[mine]])
                fits = (gap <= outer[at][:, None]) & (gap > inner[at][:, None]) & ((their_label[at][:, None] == labels[mine]) == same)
                if same:
                    fits &= theirs[at][:, None] != own_row[mine]
                asked = np.flatnonzero(fits.any(axis=1))
                if not len(asked):
                    continue
                at, fits, score = at[asked], fits[asked], product(x[asked], y)
                lowest = np.iinfo(np.int64).min
                score = np.where(fits, score, lowest).astype(np.int64)
                for band in range(1 if same else max(len(bands[i]) for i in at)):
                    now = score.copy()
                    if not same:
                        edges = np.array([(b[band]["low"], b[band]["high"]) if band < len(b := bands[i]) else (1, 0) for i in at])
                        now[(now < edges[:, :1]) | (now > edges[:, 1:])] = lowest
                    for _ in range(k):
                        best = now.argmax(axis=1)
                        top = now[np.arange(len(at)), best]
                        ok = np.flatnonzero(top > lowest)
                        if not len(ok):
                            break
                        out.append((theirs[at[ok]], np.full(len(ok), band), own_row[mine[best[ok]]], ids[mine[best[ok]]], top[ok]))
                        now[ok, best[ok]] = lowest
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 5
            return pa.table([pa.array(c) for c in columns], names=["anchor", "band", "row", "vec_id", "score"])

        part = anchors.select("group", "v", "inner", "outer").mapInArrow(reach, "group long, size int, pivot int, least double, most double")
        part = part.groupBy("group", "size", "pivot").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        both = self.spans.join(small(cut(part)), ["size", "pivot"]).where("low <= most AND high >= least").select("block", "group").distinct()
        both = small(cut(both))
        left = self.table.select("row", "vec_id", "label", "v", "pivot", "key", "block").join(both, "block")
        right = anchors.join(both, "group")
        found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(meet, "anchor long, band long, row long, vec_id long, score long")
        return first_of(found, k)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each anchor and band, ties by smaller vec_id."""
    rank = F.row_number().over(Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def distance_of(square, score, longest: float):
    """Distance of an anchor, of that squared length, to an augmented row of that score; null where that is null."""
    far = square + longest**2 - 2 * score
    return F.when(far > 0, F.sqrt(far)).when(far.isNotNull(), 0.0)


def searched(index: Index, anchors: DataFrame, k: int, same: bool, first) -> DataFrame:
    """The ``k`` best rows of every band of every anchor, by two scans: up to the radius ``first``, then, where that doesn't
    certify them, up to the one that does."""
    far = F.lit(4 * index.longest + 1.0)  # beyond all rows
    slack = F.lit(SLACK * index.longest)
    edge = distance_of(F.col("square"), F.col("low"), index.longest) + slack if not same else far
    begun = anchors.withColumns({"inner": F.lit(-1.0), "outer": F.least(first, far)})
    found = cut(index.scan(begun, k, same))
    kth = found.where(F.col("rank") == k).select(F.col("anchor").alias("row"), "band", F.col("score").alias("kth"))
    bands = begun.select("row", "square", "outer", F.posexplode("bands").alias("band", "b")).select("row", "square", "outer", F.col("band").cast("long").alias("band"), F.col("b.low").alias("low"))
    need = F.least(F.coalesce(distance_of(F.col("square"), F.col("kth"), index.longest) + slack, far), edge)
    open_ = bands.join(kth, ["row", "band"], "left").withColumn("need", need).where("need > outer").groupBy("row").agg(F.max("need").alias("need"))
    open_ = cut(open_)
    n = open_.count()
    if not n:
        return found
    again = begun.join(small(open_, n), "row").withColumns({"inner": F.col("outer") - slack, "outer": F.col("need")}).drop("need")
    more = index.scan(again, k, same)
    both = found.drop("rank").unionByName(more.drop("rank")).dropDuplicates(["anchor", "band", "row"])  # the scans overlap by the slack
    return cut(first_of(both, k))


def mine(vectors: DataFrame, where="vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the anchors that ``where`` tells: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score."""
    index = Index(vectors)
    anchors = index.anchors(where)
    band = "array<struct<low: long, high: long>>"
    one = anchors.withColumn("bands", F.array(F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))).cast(band))
    # a first guess: the distance at which a row has a quarter of the longest possible score
    guess = distance_of(F.col("square"), F.sqrt("square") * index.longest / 4, index.longest)
    found = searched(index, one, positives, True, guess)
    pairs = found.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    score = F.col("positive_score")
    edges = F.struct(F.expr(f"(positive_score * {low} + 99) div 100").alias("low"), F.expr(f"positive_score * {high} div 100").alias("high"))
    of = pairs.where(score >= 0).select("anchor", score, edges.alias("edges")).distinct()  # below 0 the band is empty
    bands = of.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("positive_score", "edges"))).alias("of"))  # ``positives`` at most
    bands = cut(bands)
    asked = anchors.join(bands.select(F.col("anchor").alias("row"), F.transform("of", lambda x: x["edges"]).cast(band).alias("bands")), "row")
    top = F.array_min(F.transform("bands", lambda b: b["high"]))
    worse = searched(index, asked, negatives, False, distance_of(F.col("square"), top, index.longest) + SLACK * index.longest)
    numbered = bands.select("anchor", F.posexplode("of").alias("band", "o")).select("anchor", F.col("band").cast("long").alias("band"), F.col("o.positive_score").alias("positive_score"))
    worse = worse.join(numbered, ["anchor", "band"]).select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    rows = pairs.join(worse, ["anchor", "positive_score"]).join(names, "anchor")
    return rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th row of the embeddings among all of them."""
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH r AS (SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.n, a.vec_id AS anchor_id, b.n AS m, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON len(a.v) = len(b.v) AND a.n <> b.n WHERE a.vec_id % 50 = 0),
p AS (SELECT n, anchor_id, m, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) <= 5),
g AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.n, p.m ORDER BY s.score DESC, s.vec_id, s.m) AS k
  FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, k::INTEGER AS rank, negative_id, positive_score, negative_score FROM g WHERE k <= 3
"""
