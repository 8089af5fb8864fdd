"""Exact Jaccard self-join of documents over word n-grams, as a blocked sparse matrix product.

Rows of the matrix are the distinct n-gram sets (documents of equal sets are one row), columns are n-grams.
Columns are put in one global order, those common in a bounded sample of documents last and by falling rarity.
Two rows of n and m n-grams that reach the threshold overlap in at least a = ceil(t (n + m) / (1 + t)) columns, and
so in at least l columns within the first n - a + l of the one and m - a + l of the other. So only the first entries
of a row enter the product, and an entry meets only those that it can reach under the bound of both sizes. The
product runs in blocks of columns: a block sorts its entries by column, multiplies within each column, and adds up
overlaps per pair; the blocks' counts are added by an aggregation. Pairs whose accumulated overlap is below l are
discarded, the others are verified on their whole sets.

Large groups of near copies would still square. They are joined first: rows that share a min-hash are each
compared with two rows of the share group only (stars; one centre is the row with the fewest rare columns, which is
close to what the copies were made from), and what passes exact verification is merged. The product then skips
pairs that are already in one component, as they can't change the result. No link between different components is
lost, so components are exact.

Defined cases: null text or text without words has an empty set, links with nothing and is its own component;
a null doc_id takes part by its text and reports the smallest non-null doc_id of its component; repeated rows
are one class and each give a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import components, cut, slices, small, spread_join, table, text_of
from candlespark.llm.shingles import mix, set_signature, shingle_sets

SIZE = 5
PERCENT = 80
#: Min-hashes per set that propose stars, and how many must agree before a star is verified.
KEYS, AGREE = 16, 10
#: Documents in the sample that finds common columns (so many at least, and one in SAMPLE_PART of all), and the most
#: columns kept as common. They only set the columns' order, that is the speed; the result is the same under any order.
SAMPLE_DOCS, SAMPLE_PART, COMMON = 32_768, 256, 500_000
COMMON_FROM = 3


def need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that is similar enough."""
    return (percent * n + 99) // 100


def least_overlap(n, m, percent: int):
    """Least overlap of similar enough sets of ``n`` and ``m``; numbers or arrays of them."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def shared_first(n, m):
    """How many columns must be shared within the first entries of sets of ``n`` and ``m``."""
    return 1 + (n + m) // 400


def sets_of(docs: DataFrame, size: int, made, schema: str) -> DataFrame:
    """``docs(key, text)`` through ``made(key, set) -> tuple`` over shingle sets, batch by batch."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        arrow = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])
        for batch in slices(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            rows = [made(d, s) for d, s in zip(batch.column("key").to_pylist(), shingle_sets(texts, size))]
            columns = list(zip(*rows)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, schema)


def head(hashes):
    """The upper 32 bits of 64-bit hashes."""
    import numpy as np

    return (hashes >> np.uint64(32)).astype(np.uint32)


def common_columns(docs: DataFrame, size: int):
    """Sorted 32-bit heads of the hashes of columns that are common in the sample, and their counts there. Heads
    of different columns may meet, which only moves a column in the order."""
    import numpy as np

    n = docs.count()
    sample = max(SAMPLE_DOCS, n // SAMPLE_PART)
    if n > sample:
        docs = docs.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000_000)) < int(1_000_000_000 * sample / n))

    def unfold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(head(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_sets(texts, size)])).view(np.int32))], names=["h"])

    counts = docs.select("text").mapInArrow(unfold, "h int").groupBy("h").count().where(F.col("count") >= COMMON_FROM)
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    hashes, uses = rows["h"].to_numpy(dtype=np.int32).view(np.uint32), rows["count"].to_numpy(dtype=np.int64)
    order = hashes.argsort()
    return hashes[order], uses[order]


def sketches(docs: DataFrame, size: int, percent: int, common) -> DataFrame:
    """Per document: key, signature and size of its set, an order of rareness, min-hashes, and its first entries."""
    import numpy as np

    hashes, uses = common
    odd = mix(np.arange(1, KEYS + 1, dtype=np.uint64)) | np.uint64(1)

    def made(key, s):
        n, sig = len(s), set_signature(s)
        if not n:
            return key, sig, 0, 0, b"", b""
        keys = mix(np.array([(s * k).min() for k in odd]) ^ odd)
        first = n - need(n, percent) + shared_first(n, n * 100 // percent + 1)
        if len(hashes):
            heads = head(s)
            at = np.minimum(np.searchsorted(hashes, heads), len(hashes) - 1)
            rank = np.where(hashes[at] == heads, uses[at], 0)
            chosen = s[np.argsort(rank, kind="stable")[:first]]  # s is sorted: ties stay in the order of hashes
            rare = int((rank == 0).sum()) * 1_000_000 // n
        else:
            chosen, rare = s[:first], 1_000_000
        return key, sig, n, (rare << 20) + (sig & 0xFFFFF), keys.tobytes(), chosen.tobytes()

    return sets_of(docs, size, made, "key long, sig long, n long, rare long, keys binary, entries binary")


def unfolded(rows: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the packed 64-bit values of a binary ``column`` as rows of their own, in ``out``, and their
    places in ``at``."""
    others = [c for c in rows.columns if c != column]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for part in slices(batches, 256):
            packed = part.column(column).to_pylist()
            each = np.repeat(np.arange(len(packed)), [len(p) // 8 for p in packed])
            values = np.frombuffer(b"".join(packed), dtype=np.int64)
            places = np.arange(len(values)) - np.searchsorted(each, each)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(places), *(part.column(c).take(pa.array(each)) for c in others)], names=[out, "at", *others])

    return rows.select(column, *others).mapInArrow(run, ", ".join([f"{out} long", "at long", *(f"{c} long" for c in others)]))


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of set signatures whose whole sets are similar enough. Only the texts of one
    document per signature in question are read again."""
    import numpy as np

    asked = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    where = cut(members.join(asked, "sig", "left_semi").groupBy("sig").agg(F.min("key").alias("key")))
    chosen = docs.join(small(where.select("key").distinct()), "key", "left_semi")
    sets = sets_of(chosen, size, lambda d, s: (set_signature(s), s.tobytes()), "sig long, hashes binary")
    sets = sets.join(where.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            a, b = batch.column("a"), batch.column("b")
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("x")), "a")
    return both.join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("y")), "b").mapInArrow(run, "a long, b long")


def one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` with one row per non-empty set. Only what comes more than once is looked up, so rows needn't move."""
    copies = rows.where("n > 0").groupBy("sig").agg(F.min("row").alias("first"), F.count("*").alias("m")).where("m > 1")
    return rows.where("n > 0").join(small(cut(copies.select("sig", "first"))), "sig", "left").where("first IS NULL OR first = row")


def stars(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set and a centre that shares a min-hash with it, where enough min-hashes agree."""
    import numpy as np

    keys = unfolded(sets.select("sig", "rare", "keys"), "keys", "key")
    any_of = F.min_by("sig", F.xxhash64("sig", "key"))
    centres = keys.groupBy("key").agg(F.min_by("sig", "rare").alias("c"), any_of.alias("d"), F.count("*").alias("m")).where("m > 1")
    pairs = keys.join(centres.select("key", F.explode(F.array("c", "d")).alias("a")), "key").where("sig <> a")
    pairs = pairs.select(F.least("a", "sig").alias("a"), F.greatest("a", "sig").alias("b")).distinct()
    side = lambda k: sets.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("keys").alias(f"k{k}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 5_000):
            packed = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.int64).reshape(-1, KEYS) for c in ("ka", "kb")]
            keep = (packed[0] == packed[1]).sum(1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long")


def block_products(entries: DataFrame, percent: int) -> DataFrame:
    """``entries(column, at, n, apart, sig)``, dealt out by column and sorted by it, to the pairs of rows of different
    components whose overlap within their first entries reaches the bound of their sizes. ``apart`` is component
    XOR signature, 0 for most rows, so that it takes no room in the shuffle."""
    import numpy as np

    fields = ("column", "at", "n", "apart", "sig")

    def multiply(column, at, n, apart, sig):
        out, comp = [], sig ^ apart
        begins = np.flatnonzero(np.concatenate([[True], column[1:] != column[:-1]]))
        length = np.diff(np.append(begins, len(column)))
        several = np.minimum.reduceat(comp, begins) != np.maximum.reduceat(comp, begins)
        live = np.repeat(several, length)
        column, at, sig, n, comp = (v[live] for v in (column, at, sig, n, comp))
        for lag in range(1, int(length[several].max(initial=1))):
            i = np.flatnonzero((column[lag:] == column[:-lag]) & (comp[lag:] != comp[:-lag]))
            j = i + lag
            slack = shared_first(n[i], n[j]) - least_overlap(n[i], n[j], percent)
            reach = (at[i] < n[i] + slack) & (at[j] < n[j] + slack)
            i, j = i[reach], j[reach]
            swap = sig[i] > sig[j]
            out.append(np.stack([np.where(swap, sig[j], sig[i]), np.where(swap, sig[i], sig[j]), np.where(swap, n[j], n[i]), np.where(swap, n[i], n[j])]))
        return out

    def summed(parts):
        import pyarrow as pa

        a, b, na, nb = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), dtype=np.int64)
        order = np.lexsort((b, a))
        a, b, na, nb = a[order], b[order], na[order], nb[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
        count = np.diff(np.append(new, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (a[new], b[new], na[new], nb[new], count)], names=["a", "b", "na", "nb", "overlap"])

    def run(batches: Iterator) -> Iterator:
        rest, parts, size = None, [], 0
        for batch in batches:
            got = [batch.column(c).to_numpy() for c in fields]
            if not len(got[0]):
                continue
            if rest is not None:
                got = [np.concatenate(x) for x in zip(rest, got)]
            last = np.searchsorted(got[0], got[0][-1])
            rest = [v[last:] for v in got]
            if last:
                new = multiply(*(v[:last] for v in got))
                parts += new
                size += sum(x.shape[1] for x in new)
                if size > 500_000:
                    yield summed(parts)
                    parts, size = [], 0
        if rest is not None:
            parts += multiply(*rest)
        yield summed(parts)

    dealt = entries.repartition("column").sortWithinPartitions("column")
    blocks = dealt.mapInArrow(run, "a long, b long, na long, nb long, overlap long")
    pairs = blocks.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"), F.sum("overlap").alias("overlap"))
    return pairs.where(F.col("overlap") >= 1 + F.floor((F.col("na") + F.col("nb")) / F.lit(400))).select("a", "b")


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT):
    """The join over ``docs(doc_id, text)``: members (key, sig, n), a row per document, with the key of ``keyed``; and
    components (sig, component) of the signatures that link with others."""
    docs = keyed(docs)
    rows = cut(sketches(docs, size, percent, common_columns(docs, size)).withColumn("row", F.monotonically_increasing_id()))
    members, sets = rows.select("key", "sig", "n"), one_of_each(rows)
    first = cut(verified(stars(sets, percent), docs, members, size, percent))
    merged = cut(components(first).withColumnRenamed("id", "sig"))
    entries = sets.select("n", "entries", "sig").join(small(merged), "sig", "left")
    apart = F.coalesce(F.col("component").bitwiseXOR(F.col("sig")), F.lit(0).cast("long"))
    entries = entries.select("entries", "n", apart.alias("apart"), "sig")
    pairs = cut(block_products(unfolded(entries, "entries", "column"), percent))
    second = verified(pairs, docs, members, size, percent)
    merged_pairs = merged.where("sig <> component").select(F.col("sig").alias("a"), F.col("component").alias("b"))
    return members, components(merged_pairs.unionByName(second)).withColumnRenamed("id", "sig")


def row_key():
    """A document's identity: a digest of doc_id and text; rows equal in both are one document."""
    return F.xxhash64("doc_id", text_of())


def keyed(docs: DataFrame) -> DataFrame:
    """key and text of ``docs``."""
    return docs.select(row_key().alias("key"), text_of().alias("text"))


def grouped(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, key, n (size of its set) and group, null where the set is empty."""
    members, linked = classes(docs, size, percent)
    facts = members.distinct().join(linked, "sig", "left")
    facts = facts.select("key", "n", F.when(F.col("n") > 0, F.coalesce("component", "sig")).alias("group"))
    return docs.select("doc_id", row_key().alias("key")).join(facts, "key")


def ngram_join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    rows = cut(grouped(docs, size, percent))
    least = rows.where("group IS NOT NULL").groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    found = spread_join(rows.where("group IS NOT NULL"), least, "group", "m").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    empty = rows.where("group IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(empty)


def first_of_groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest doc_id (null last). Documents with an empty set
    all stay; of rows equal in doc_id and text one stays."""
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    doc_id, text = F.col(f"c{own.index('doc_id')}"), F.coalesce(F.col(f"c{own.index('text')}"), F.lit(""))
    rows = cut(grouped(plain.select(doc_id.cast("long").alias("doc_id"), text.alias("text")), size, percent))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "key")
    owners = rows.where("group IS NOT NULL").groupBy("group").agg(F.min(rank).alias("owner"), F.count("*").alias("m"))
    gone = spread_join(rows, owners.where("m > 1"), "group", "m").where(F.col("key") != F.col("owner")["key"]).select("key").distinct()
    repeated = rows.where("group IS NOT NULL").groupBy("key").count().where("count > 1").select("key")
    kept = plain.withColumn("key", F.xxhash64(doc_id.cast("long"), text)).join(small(cut(gone)), "key", "left_anti")
    repeated = small(cut(repeated))
    once = kept.join(repeated, "key", "left_anti").unionByName(kept.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return once.select(*plain.columns).toDF(*own)


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents over five-word shingles at Jaccard 0.8."""
    return ngram_join(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
