"""Near duplicates among embeddings by collision-counting projections.

Unit vectors are projected on many random lines. In each round the vectors are sorted by one projection inside
cells of a coarse code (signs of a few further projections, their number growing with the logarithm of the row
count, so that cells keep their size), and every vector is paired with those in the window centred on it. The
collisions of a pair are counted over all rounds; a pair whose count passes a threshold is verified by its cosine in
double precision. Rounds are calibrated to the threshold, so that a true link passes it.

A round shuffles a cell, a value and an id per vector, and an id pair per collision, so the bytes a vector grow with the
number of rounds (42 for 50 thousand vectors, 205 for a thousand million), not with its square.

Equal vectors are one class and take part once. A cell beyond ``TILE`` rows (a group of near copies) is split into
tiles of row groups against row groups, so no task holds more than two groups, and no pair is lost. In a group of near
copies every pair is a link, and is counted in each round in which it meets.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and
are components of their own; vectors of different length never link; vectors of more than 65,535 components are
refused; every row counts as a vector of its own, repeated rows too; a row with null vec_id links with nothing and has
a null component, not kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import components, cut, slices, small, spread_join, table

COSINE = 0.95
#: Rows that a cell holds on average, rows beyond which a cell is split, collisions of a candidate, and the chance to
#: miss a link.
CELL, TILE, LEAST, MISS = 8, 2_000, 2, 2e-4
SEED = 20_240_101
#: Window slack for values that rows carry in single precision.
SLACK = 1e-5


def below(n: int, p: float, least: int) -> float:
    """Chance of fewer than ``least`` successes in ``n`` trials."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least))


def plan(rows: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """Rounds, bits per cell and half window for ``rows`` vectors. Rounds are independent, and in each a link at
    ``cosine`` has the same code and lies in the window with a chance that is known; links beyond it meet more often."""
    distance = math.sqrt(2 - 2 * cosine)
    half = 2 * distance
    inside = math.erf(half / distance / math.sqrt(2))
    bits = max(0, round(math.log2(max(rows, 1) / CELL)))
    meets = (1 - math.acos(cosine) / math.pi) ** bits * inside
    rounds = LEAST
    while below(rounds, meets, LEAST) > MISS:
        rounds += 1
    return rounds, bits, half


def usable(v: Column) -> Column:
    """True for vectors that have a direction."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def by_length(column) -> Iterator:
    """An Arrow column of vectors as (row numbers, matrix) per vector length, out of its flat buffer."""
    import numpy as np

    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == size)
        yield own, flat[starts[own][:, None] + np.arange(size)]


def units(x):
    """Unit vectors in double precision of the rows of a matrix."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projected(classes: DataFrame, rounds: int, bits: int) -> DataFrame:
    """``classes(id, v)`` to a row per round: cell (code, round and vector length in one number), value and id."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            ids = batch.column("id").to_numpy()
            for own, x in by_length(batch.column("v")):
                size = x.shape[1]
                if size >= 1 << 16:
                    raise ValueError(f"a vector of {size} components is too long")
                rng = np.random.default_rng([SEED, size])
                lines, planes = rng.standard_normal((size, rounds)), rng.standard_normal((size, rounds * bits))
                u = units(x)
                signs = (u @ planes > 0).reshape(len(own), rounds, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64))
                cells = (codes << 28) + (np.arange(rounds) << 16) + size
                values = (u @ lines).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), pa.array(values.ravel()), pa.array(np.repeat(ids[own], rounds))], names=["cell", "value", "id"])

    return classes.select("id", "v").mapInArrow(run, "cell long, value float, id long")


def collisions(rows: DataFrame, half: float) -> DataFrame:
    """Pairs (a, b) of ids whose windows collide in LEAST rounds or more."""
    counts = rows.groupBy("cell").count().where(F.col("count") > TILE)
    hot = small(cut(counts.select("cell", F.ceil(F.col("count") / F.lit(TILE)).cast("int").alias("groups"))))
    rows = rows.join(hot, "cell", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    tile = ["cell", "low", "high"]
    fields = [*tile, "own", "value", "id"]

    def meet(group, diagonal, own, value, ids) -> Iterator:
        """Ids of all pairs of a group that lie in one another's window, some hundred thousand at a time."""
        import numpy as np

        place = value.astype(np.float64) + group * 1e3
        order = np.argsort(place, kind="stable")
        place = place[order]
        more = np.searchsorted(place, place + half + SLACK, side="right") - np.arange(len(place)) - 1
        begin = 0
        while begin < len(place):
            end = int(np.searchsorted(np.cumsum(more[begin:]), 400_000)) + begin + 1
            i = np.repeat(np.arange(begin, min(end, len(place))), more[begin:end])
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[begin:end]) - more[begin:end], more[begin:end])
            i, j = order[i], order[j]
            begin = end
            cross = diagonal[i] | (own[i] != own[j])
            i, j = ids[i[cross]], ids[j[cross]]
            yield np.minimum(i, j), np.maximum(i, j)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def work(part):
            cols = {c: part.column(c).to_numpy() for c in fields}
            key = np.stack([cols[c].astype(np.int64) for c in tile], axis=1)
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            for a, b in meet(np.cumsum(new) - 1.0, key[:, 1] == key[:, 2], cols["own"], cols["value"], cols["id"]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*([rest] if rest is not None else []), batch]).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in tile], axis=1)
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield from work(whole.slice(0, last))
            rest = whole.slice(last)
        if rest is not None:
            yield from work(rest)

    dealt = rows.select(*fields).repartition(*tile).sortWithinPartitions(*tile)
    met = dealt.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("met"))
    return met.where(F.col("met") >= LEAST).select("a", "b")


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """``vectors(vec_id, embedding)`` to classes (id, v, name, copies) of equal vectors and links (a, b) between them."""
    classes = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    classes = classes.groupBy("v").agg(F.min("vec_id").alias("name"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))  # kept, so the numbers stay as they are
    n = classes.count()
    rounds, bits, half = plan(n, cosine)
    pairs = collisions(projected(classes, rounds, bits), half)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 2_000):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for (own, x), (_, y) in zip(by_length(batch.column("x")), by_length(batch.column("y"))):
                keep[own] = (units(x) * units(y)).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return classes, cut(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    classes, linked = links(vectors, cosine)
    copies = classes.select("id", "copies")
    both = linked.union(linked.select("b", "a"))
    counts = both.join(copies.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("linked"))
    facts = classes.join(counts, "id", "left").join(components(linked), "id", "left")
    facts = facts.select("v", "name", "copies", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("root"))
    facts = facts.join(facts.groupBy("root").agg(F.min("name").alias("component_id")), "root").drop("root", "name")
    ok = usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.when(ok, F.col("embedding").cast("array<double>")).alias("v"))
    out = spread_join(rows.where("v IS NOT NULL"), facts, "v", "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links of all embeddings at cosine 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))

