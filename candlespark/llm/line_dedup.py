"""Fuzzy line deduplication by MinHash.

Lines are compared in a normal form (lower case, white space collapsed). Equal lines are found by a 96-bit
digest, of which 64 bits are a line's identity among candidates; a distinct line also gets a MinHash signature of its character shingles, cut into bands, so that similar
lines meet under some band key with high probability. Lines under one key are first each compared with one of them
(a star), by the exact Jaccard of their shingle sets, and passed comparisons are merged by distributed union-find.
Then all lines of a key that are still in different components are compared with each other, without a cap. Of every
component only the first line, by document and line number, stays.

Hot keys: a task proposes stars among its own batch first, so a key leaves a batch once, whatever its count;
equal lines leave their signature once per task; owners of components are pre-aggregated; the comparison of a key's
lines is dealt out in tiles of at most about 2 * ``TILE`` lines, where exact bounds (set sizes and bit maps of the
sets) spare most comparisons of sets and a tile links two components once.

Defined cases: null text stays null and has no lines; lines under ``min_chars`` normal characters are never
touched; a document that loses all its lines keeps its row with an empty text (``deduplicate``); rows equal in
doc_id and text count as one document and get the same lines; null doc_id sorts after all others; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import components, cut, narrow_batches, once, slices, small, spread_join, table
from candlespark.llm.ngram_join import unfolded
from candlespark.llm.shingles import BASE, STEP, _tables, mix, powers

SHINGLE = 7
PERCENT = 80
#: Bands of a signature and rows of a band: at Jaccard 0.8 a pair meets with probability 0.985, at 0.9 0.9998.
BANDS, ROWS = 8, 4
MIN_CHARS = 10
#: Characters hashed at once (what a core's cache holds), and digests a task remembers so as to sign equal lines once.
CHUNK, SEEN = 30_000, 500_000
#: Lines beyond which a key's comparison is split, bits of a set's map, and sets that a task remembers.
TILE, BITS, SETS = 2_000, 1_024, 20_000
LINE = struct.Struct("<qi")
#: White space besides the blank and the end of a line.
ODD_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Lines whose band keys leave a task together, and keys that one bucket of the candidates' shuffle holds, about.
GATHER, BUCKET = 40_000, 8_192


def normal(line: str) -> str:
    """The form in which lines are compared."""
    return " ".join(line.lower().split())


def normal_lines(text: str) -> list[str]:
    """The normal form of every line of ``text``; where blanks are the only white space, lines aren't split into words."""
    if not any(c in text for c in ODD_SPACE):
        return [normal(line) if "  " in line else line.strip(" ") for line in text.lower().split("\n")]
    return [normal(line) for line in text.split("\n")]


def digest(line: str) -> tuple[int, int]:
    """Signed 64-bit digest of a line's normal form, and 32 further bits that tell lines of one such digest apart."""
    return LINE.unpack(hashlib.blake2b(line.encode(), digest_size=12).digest())


def windows(text: str, size: int):
    """Hashes of all runs of ``size`` characters of ``text``."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    if len(points) < size:
        return mix(points[:1] + np.uint64(len(points)))
    values = points * np.uint64(STEP)
    values ^= values >> np.uint64(29)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(points)), out=total[1:])
    n = len(points) - size + 1
    inverse = _tables.setdefault("inverse", pow(BASE, -1, 1 << 64))
    return mix((total[size:] - total[:n]) * powers(inverse, n))


def runs(chars: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of items of at most CHUNK characters together, or of one item."""
    at = 0
    while at < len(chars):
        upto, total = at + 1, chars[at]
        while upto < len(chars) and total + chars[upto] <= CHUNK:
            total += chars[upto]
            upto += 1
        yield at, upto
        at = upto


def overlaps(left: list[str], right: list[str], size: int):
    """Sizes of the shingle sets of ``left`` and ``right``, and of their intersections, line by line."""
    import numpy as np

    number: dict[str, int] = {}
    sides = [np.fromiter((number.setdefault(line, len(number)) for line in side), dtype=np.int64, count=len(side)) for side in (left, right)]
    lines = list(number)
    ramp = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    n = np.maximum(lengths - size + 1, 0)
    who = [np.repeat(np.arange(len(lines)), n)]
    values = [windows("".join(lines), size)[np.repeat(np.cumsum(lengths) - lengths, n) + ramp(n)]]
    for i in np.flatnonzero(n == 0).tolist():  # shorter than a shingle
        values.append(windows(lines[i], size))
        who.append(np.full(len(values[-1]), i))

    # a window's place among all distinct ones stands for it, so that plain sorts of numbers do
    who, values = np.concatenate(who), np.unique(np.concatenate(values), return_inverse=True)[1]
    m = int(values.max(initial=0)) + 1
    packed = np.sort(who * m + values)
    packed = packed[np.append(True, packed[1:] != packed[:-1])[: len(packed)]]
    first = np.searchsorted(packed, np.arange(len(lines) + 1) * m)
    n, values = np.diff(first), packed % m
    places = np.concatenate([np.repeat(first[side], n[side]) + ramp(n[side]) for side in sides])
    packed = np.sort(np.concatenate([np.repeat(np.arange(len(side)), n[side]) for side in sides]) * m + values[places])
    return n[sides[0]], n[sides[1]], np.bincount(packed[1:][packed[1:] == packed[:-1]] // m, minlength=len(left))


def band_keys(lines: list[str], size: int):
    """Matrix of band keys (signed 64-bit), a row per line; lines are at least ``size`` characters long."""
    import numpy as np

    n = BANDS * ROWS
    odd = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = np.empty((n, len(lines)), dtype=np.uint32)
    for at, upto in runs(list(map(len, lines))):
        hashes = (windows("".join(lines[at:upto]), size) >> np.uint64(32)).astype(np.uint32)
        lengths = np.fromiter(map(len, lines[at:upto]), dtype=np.int64, count=upto - at)
        own = np.ones(len(hashes), dtype=bool)  # not across the end of a line
        for k in range(1, size):
            own[np.cumsum(lengths)[:-1] - k] = False
        hashes = hashes[own]
        starts, turned = np.cumsum(lengths - size + 1) - (lengths - size + 1), np.empty_like(hashes)
        for k in range(n):
            np.multiply(np.bitwise_xor(hashes, odd[n - 1 - k], out=turned), odd[k], out=turned)
            np.minimum.reduceat(turned, starts, out=least[k, at:upto])
    wide = least.T.reshape(len(lines), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(STEP), (len(lines), 1))
    for r in range(ROWS):
        keys = mix(keys ^ (wide[:, :, r] + np.uint64(r << 32)))
    return keys.view(np.int64)


def line_table(docs: DataFrame, min_chars: int, size: int) -> DataFrame:
    """``docs(dk, doc_id, text)`` to a row per compared line: line, more (its digest), dk, doc_id, place, keys (packed,
    or null where this task has signed an equal line before)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()
        for batch in slices(batches, 2_000):
            columns: list[list] = [[], [], [], [], [], []]
            fresh, rows = [], []
            for dk, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("dk", "doc_id", "text"))):
                for place, line in enumerate(normal_lines(text)):
                    if len(line) < min_chars:
                        continue
                    h, more = digest(line)
                    if h not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        fresh.append(line)
                        rows.append(len(columns[0]))
                    for c, v in zip(columns, (h, more, dk, doc_id, place, None)):
                        c.append(v)
            if fresh:
                for row, keys in zip(rows, band_keys(fresh, size)):
                    columns[5][row] = keys.tobytes()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["line", "more", "dk", "doc_id", "place", "keys"])

    return docs.mapInArrow(run, "line long, more int, dk long, doc_id long, place int, keys binary")


def candidate_stars(lines: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of line digests: each line under a band key with one line of that key. Keys are shuffled in
    packed buckets, whose number follows that of the lines."""
    import numpy as np

    def propose(key, line):
        """Rows sorted by key to pairs of a key's first line with its others; and the first rows."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        centre = np.repeat(line[first], np.diff(np.append(first, len(key))))
        return first, centre

    def dealt(rows, by, paired: bool) -> Iterator:
        """``rows`` of two numbers each, packed by buckets."""
        import pyarrow as pa

        bucket = (by.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, rows = bucket[order], rows[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
        packed = [rows[at:end].tobytes() for at, end in zip(first.tolist(), [*first[1:].tolist(), len(rows)])]
        for at in range(0, len(packed), 1_000):
            part = pa.array(packed[at : at + 1_000], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first[at : at + 1_000]]), pa.array([paired] * len(part), pa.bool_()), part], names=["bucket", "paired", "packed"])

    def gathered(batches: Iterator) -> Iterator:
        keys, lines = [], []
        for batch in batches:
            keys += batch.column("keys").to_pylist()
            lines.append(batch.column("line").to_numpy())
            if len(keys) >= GATHER:
                yield keys, lines
                keys, lines = [], []
        if keys:
            yield keys, lines

    def local(batches: Iterator) -> Iterator:
        for keys, line in gathered(batches):
            keys = np.frombuffer(b"".join(keys), dtype=np.int64)
            line = np.repeat(np.concatenate(line), BANDS)
            order = np.argsort(keys, kind="stable")
            keys, line = keys[order], line[order]
            first, centre = propose(keys, line)
            other = np.flatnonzero(centre != line)
            pairs = np.unique(np.stack([centre[other], line[other]], axis=1), axis=0)
            yield from dealt(np.stack([keys[first], line[first]], axis=1), keys[first], False)
            yield from dealt(pairs, mix(pairs[:, 1].astype(np.uint64)).view(np.int64), True)

    def across(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, firsts, pairs = None, [], []  # of one bucket: keys with their lines, pairs that are proposed already

        def work():
            key, line = np.frombuffer(b"".join(firsts), dtype=np.int64).reshape(-1, 2).T
            out = [np.frombuffer(b"".join(pairs), dtype=np.int64).reshape(-1, 2).T]
            if len(key):
                order = np.argsort(key, kind="stable")
                line = line[order]
                centre = propose(key[order], line)[1]
                out.append(np.stack([centre, line])[:, centre != line])
            a, b = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for bucket, paired, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "paired", "packed"))):
                if bucket != held and held is not None:
                    yield work()
                    firsts, pairs = [], []
                held = bucket
                (pairs if paired else firsts).append(packed)
        if held is not None:
            yield work()

    signed = lines.where("keys IS NOT NULL").select("line", "keys")
    buckets = max(1, -(-signed.count() * BANDS // BUCKET))
    keyed = signed.mapInArrow(local, "bucket int, paired boolean, packed binary")
    pairs = keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(across, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contents(pairs: DataFrame, lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(line, more, content) of the lines in ``pairs(a, b)``: their digests and normal forms, from one document each. Should
    two lines have one 64-bit digest, one of them is taken; the other is no part of its component, as ``more`` tells."""
    asked = cut(pairs.select(F.col("a").alias("line")).union(pairs.select(F.col("b").alias("line"))).distinct())
    n = asked.count()
    chosen = lines.select("line", "more", "dk", "place").join(small(asked, n), "line", "left_semi").dropDuplicates(["line"])
    wanted = cut(chosen.groupBy("dk").agg(F.collect_list(F.struct("line", "more", "place")).alias("wanted")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            places = batch.column("wanted").flatten()
            each, content = iter(places.field("place").to_pylist()), []
            for text, n in zip(batch.column("text").to_pylist(), batch.column("wanted").value_lengths().to_pylist()):
                parts = text.split("\n")
                content += [normal(parts[next(each)]) for _ in range(n)]
            yield pa.RecordBatch.from_arrays([places.field("line"), places.field("more"), pa.array(content, pa.string())], names=["line", "more", "content"])

    found = docs.select("dk", "text").join(small(wanted, n), "dk").select("text", "wanted")  # about a row's bytes a line
    return found.mapInArrow(run, "line long, more int, content string").dropDuplicates(["line"])  # rows of equal documents


def verified(pairs: DataFrame, content: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose lines' shingle sets have an exact Jaccard of ``percent`` or more."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 2_000):
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            keep = np.zeros(len(x), dtype=bool)
            for at, end in runs([len(p) + len(q) for p, q in zip(x, y)]):
                nx, ny, same = overlaps(x[at:end], y[at:end], size)
                keep[at:end] = 100 * same >= percent * (nx + ny - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    both = pairs.join(content.select(F.col("line").alias("a"), F.col("content").alias("x")), "a")
    return both.join(content.select(F.col("line").alias("b"), F.col("content").alias("y")), "b").mapInArrow(run, "a long, b long")


def tile_links(sets: list, maps, part, comp, percent: int) -> list:
    """Links (i, j) that merge all components of a tile with lines alike at ``percent`` in them, none of them twice.
    ``sets`` are in order of their sizes; ``maps`` have a bit set for each member. Lines of one ``part`` aren't compared,
    where ``part`` isn't None."""
    import numpy as np

    out, n, comp = [], np.array([len(s) for s in sets]), comp.copy()
    ends = np.searchsorted(n, n * 100 // percent, side="right")
    for i in range(len(sets)):
        other = comp[i + 1 : ends[i]] != comp[i]
        if part is not None:
            other &= part[i + 1 : ends[i]] != part[i]
        j = i + 1 + np.flatnonzero(other)
        if not len(j):
            continue
        # a bit that only one map has stands for at least one member that only this set has
        own, others = np.bitwise_count(maps[i] & ~maps[j]).sum(1, dtype=np.int64), np.bitwise_count(maps[j] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - own, n[j] - others)
        for k in j[100 * most >= percent * (n[i] + n[j] - most)].tolist():
            if comp[k] != comp[i]:
                same = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * same >= percent * (n[i] + n[k] - same):
                    out.append((i, k))
                    comp[comp == comp[k]] = comp[i]
    return out


def remaining(lines: DataFrame, merged: DataFrame, content: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between lines of different components of ``merged(line, component)`` that share a band key: every two
    of them are compared, or are linked through others. Lines that share a key with another one are in ``content``."""
    asked = lines.where("keys IS NOT NULL").select("line", "keys").join(small(content.select("line")), "line", "left_semi").dropDuplicates(["line"])
    asked = cut(asked.join(small(merged), "line", "left").select("line", F.coalesce("component", "line").alias("component"), "keys"))
    keyed = unfolded(asked, "keys", "key").select("key", "line", "component")
    prints = F.bit_xor(F.xxhash64("line")).alias("p"), F.bit_xor(F.xxhash64("line", F.lit(1))).alias("q")
    open_ = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"), *prints)
    open_ = open_.where("m > 2 AND low <> high")  # the star has compared the lines of a key with two
    open_ = open_.dropDuplicates(["m", "low", "high", "p", "q"])  # keys with the very same lines: one of them will do
    open_ = small(cut(open_.select("key", F.ceil(F.col("m") / F.lit(TILE)).cast("int").alias("parts"))))
    rows = keyed.join(open_, "key").withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    tile = ["key", "low", "high"]
    rows = rows.join(content.drop("more"), "line").select(*tile, "part", "line", "component", "content")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sets: dict = {}

        def set_of(line, text):
            found = sets.get(line)
            if found is None:
                if len(sets) >= SETS:
                    sets.clear()
                members, bits = np.sort(windows(text, size)), np.zeros(BITS, dtype=bool)
                members = members[np.append(True, members[1:] != members[:-1])]
                bits[members % np.uint64(BITS)] = True
                found = sets[line] = members, np.packbits(bits).view(np.uint64)
            return found

        def work(part):
            key, low, high, own, line, comp = (part.column(c).to_numpy() for c in (*tile, "part", "line", "component"))
            text, a, b = part.column("content"), [], []
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
            for at, end in zip(new.tolist(), [*new[1:].tolist(), len(key)]):
                if (comp[at:end] == comp[at]).all():
                    continue
                found = [set_of(x, t) for x, t in zip(line[at:end].tolist(), text.slice(at, end - at).to_pylist())]
                order = np.argsort([len(s) for s, _ in found], kind="stable")
                maps, place = np.stack([found[i][1] for i in order]), at + order
                for i, j in tile_links([found[i][0] for i in order], maps, None if low[at] == high[at] else own[place], comp[place], percent):
                    a.append(line[place[i]])
                    b.append(line[place[j]])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*([rest] if rest is not None else []), batch]).combine_chunks().to_batches()[0]
            key = np.stack([whole.column(c).to_numpy().astype(np.int64) for c in tile], axis=1)
            last = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if last:
                yield work(whole.slice(0, last))
            rest = whole.slice(last)
        if rest is not None:
            yield work(rest)

    return rows.repartition(*tile).sortWithinPartitions(*tile).mapInArrow(run, "a long, b long").distinct()


def removals(docs: DataFrame, min_chars: int = MIN_CHARS, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs(dk, doc_id, text)`` to (dk, gone): the sorted places of the lines that a document loses."""
    lines = cut(line_table(docs, min_chars, size))
    pairs = cut(candidate_stars(lines))
    content = cut(contents(pairs, lines, docs))
    merged = cut(components(verified(pairs, content, size, percent)).withColumnRenamed("id", "line"))
    links = merged.where("line <> component").select(F.col("line").alias("a"), F.col("component").alias("b"))
    merged = cut(components(links.unionByName(remaining(lines, merged, content, size, percent))).withColumnRenamed("id", "line"))
    at = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "dk", "place")
    merged = cut(merged.join(content.select("line", F.col("more").alias("own")), "line"))
    rows = lines.select("line", "more", "dk", "doc_id", "place").join(small(merged), "line", "left")
    alike = F.col("own").eqNullSafe(F.col("more"))  # lines of no component are known by all 96 bits
    group = [F.when(alike, F.col("component")).otherwise(F.col("line")).alias("group"), F.when(~alike, F.col("more")).cast("long").alias("mark")]
    rows = rows.select(*group, "dk", "place", at.alias("at")).fillna(1 << 32, ["mark"])
    owners = rows.groupBy("group", "mark").agg(F.min("at").alias("owner"), F.count("*").alias("lines")).where("lines > 1")
    gone = spread_join(rows, owners, ["group", "mark"], "lines").where("at <> owner").select("dk", "place").distinct()
    return gone.groupBy("dk").agg(F.sort_array(F.collect_list("place")).alias("gone"))


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the deduplicated text, and _lines (number before) and _gone (places removed) added."""
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    doc_id, text = (F.col(f"c{own.index(c)}") for c in ("doc_id", "text"))
    keyed = plain.withColumn("dk", F.xxhash64(doc_id, text))
    gone = removals(keyed.where(text.isNotNull()).select("dk", doc_id.cast("long").alias("doc_id"), text.alias("text")), **parameters)
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone"))  # noqa: E731  by hashing, in order
    left = once(F.split(text, "\n", -1), lambda p: F.array_join(F.transform(stay(p), lambda i: F.element_at(p, i + 1)), "\n"))
    text_now = F.when(F.col("gone").isNull(), text).otherwise(left)
    columns = [text_now if c == "text" else F.col(f"c{i}") for i, c in enumerate(own)]
    lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    places = F.coalesce("gone", F.array().cast("array<int>"))
    return keyed.join(gone, "dk", "left").select(*columns, lines, places).toDF(*own, "_lines", "_gone")


def without_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with the deduplicated text (and n_chars, where there is one, of that text); documents that lost lines
    and have no word left go."""
    rows = deduplicate(docs, **parameters)
    rows = rows.where((F.size("_gone") == 0) | F.col("text").rlike(r"\S")).drop("_gone", "_lines")
    return rows.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else rows


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its lines deduplicated over the whole table."""
    narrow_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_gone").alias("removed_lines"))
