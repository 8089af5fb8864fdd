"""Document fingerprints by SpotSigs, in DataFrame functions only.

A spot signature is a common word (the anchor, or several in a row) with the next two content words. Text is
lower-cased and cut into words of letters and digits; anchors are glued to the content word after them, other
frequent words are left out, and each glued word with its successor is hashed. Every content word with its successor
is hashed as well, so that texts that are short or have few anchors have telling fingerprints too. A document's set of
signatures is its fingerprint. The rule is the same for texts of all lengths, so a set changes only with edited words.

Fingerprints are compared by Jaccard, pruned by length: sets can't be more alike than the shorter length over the
longer. ``near_documents`` deals sets out by length class and signature, so only sets of near lengths meet.

Defined cases: null text is empty; texts without any word have an empty fingerprint, and two empty ones are alike
by 1, an empty and another by 0; null doc_id comes after all others in the order of documents; equal and null doc_ids
are ordered by a digest of the text; of a single document the next is itself; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import components, cut, once, table, text_of

#: Anchors, and frequent words that are neither anchors nor content (English, German, French, Spanish).
ANCHORS = "the a is was of to der die das ist ein und le la les est et un el los es y que de".split()
SKIPPED = "in on at by for with that this be are as or it mit von zu den im auf en du des dans pour par con por se al".split()
CHAIN_MARK = ">"
#: Documents per block of the order of documents, about (more only beyond BLOCK * BLOCKS, 600 million, documents), the
#: most blocks, and quantile cells.
BLOCK, BLOCKS, CELLS = 2_000, 300_000, 128
#: Classes beyond which the comparison under a signature is split into tiles.
TILE = 2_000


def spot_signatures(text: Column) -> Column:
    """Sorted distinct 64-bit signatures of a text."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    content = F.regexp_replace(plain, f"(?<= )(?:{'|'.join(SKIPPED)}) ", "")
    glued = F.regexp_replace(content, f"(?<= )({'|'.join(ANCHORS)}) ", f"$1{CHAIN_MARK}")
    words = F.filter(F.split(F.trim(glued), " "), lambda w: w != "")
    return once(words, lambda w: F.array_sort(F.array_distinct(chained(w))))


def chained(words: Column) -> Column:
    """Hashes of the anchored words, and of all content words without their anchors, each with its successor."""
    bare = F.transform(words, lambda w: F.substring_index(w, CHAIN_MARK, -1))
    pairs = F.arrays_zip(words.alias("w"), bare.alias("b"), F.concat(F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(0))), F.array(F.lit(""))).alias("n"))
    anchored = F.transform(F.filter(pairs, lambda p: p["w"].contains(CHAIN_MARK)), lambda p: F.xxhash64(p["w"], p["n"]))
    every = F.transform(pairs, lambda p: F.xxhash64(p["b"], p["n"]))
    return F.when(F.size(words) == 0, F.array().cast("array<long>")).otherwise(F.concat(anchored, every))


def fingerprint(signatures: Column) -> Column:
    """A set of signatures as text: its size and its members' low 32 bits, in order."""
    short = F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(s.bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.concat(F.size(signatures).cast("string"), F.lit(":"), F.array_join(short, ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 without comparing where their lengths bound it below ``least``."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    exact = same.cast("double") / (F.size(a) + F.size(b) - same)
    return F.when(high == 0, F.lit(1.0)).when((low == 0) | (low < F.lit(least) * high), F.lit(0.0)).otherwise(exact)


def blocks(keys: DataFrame) -> tuple[Column, int]:
    """A block number that rises with (``k``, ``h``), longs, null ``k`` last; and the number of blocks.

    The keys are cut at quantiles, and each piece evenly into blocks of about BLOCK rows. A key that holds so many rows
    that it is several quantiles, and the rows without one, are cut by ``h``, a digest. Only the quantiles, a bounded
    list, come to the driver.
    """
    knots = F.percentile_approx("k", [i / CELLS for i in range(CELLS + 1)], 100 * CELLS)
    facts = keys.agg(F.count("k").alias("n"), F.count_if(F.col("k").isNull()).alias("nulls"), knots.alias("q")).first()
    per_cell = max(1, -(-min(BLOCKS, -(-facts["n"] // BLOCK)) // CELLS)) if facts["n"] > BLOCK else 1
    known, pieces, base = sorted(facts["q"] or []), [], 0  # pieces: first key, width of a block (0: cut by h), first block, blocks
    for q, after in zip(sorted(set(known)), [*sorted(set(known))[1:], None]):
        times = known.count(q)
        if times > 1:
            pieces.append((q, 0, base, (times - 1) * per_cell))
            base += (times - 1) * per_cell
        begin = q + 1 if times > 1 else q
        if after is not None and begin < after:
            pieces.append((begin, -(-(after - begin) // per_cell), base, per_cell))
            base += per_cell
        elif after is None and times == 1:
            pieces.append((begin, 1, base, 1))
            base += 1
    for_nulls = max(1, min(BLOCKS, -(-facts["nulls"] // BLOCK)))
    by_h = lambda n: F.least(F.greatest(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * n), F.lit(0)), n - 1)
    null_block = F.lit(base).cast("long") + by_h(F.lit(for_nulls).cast("long"))
    if not pieces:
        return null_block, base + for_nulls
    row = lambda p: F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(("first", "width", "base", "n"), p)])
    piece = F.element_at(F.filter(F.array(*map(row, pieces)), lambda p: p["first"] <= F.greatest(F.col("k"), F.lit(pieces[0][0]))), -1)
    inside = lambda p: F.when(p["width"] == 0, by_h(p["n"])).otherwise(F.least(F.floor(F.greatest(F.col("k") - p["first"], F.lit(0)) / p["width"]), p["n"] - 1))
    return F.when(F.col("k").isNull(), null_block).otherwise(once(piece, lambda p: p["base"] + inside(p))), base + for_nulls


def with_next(docs: DataFrame, carried: list[str], derived: dict[str, Column] | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``derived`` columns, and next_<c> for the ``carried`` columns of the document
    after it by doc_id (after the last: the first). Texts are shuffled once, by block, and derived columns are made
    behind the shuffle, so they don't move; a block's first document is sent to the block before it too. The blocks'
    first keys are broadcast: at most 2 * BLOCKS + CELLS rows of six numbers, 40 MB."""
    rows = docs.withColumn("k", F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("k"))
    rows = rows.withColumn("block", blocks(keys)[0]).withColumn("z", F.col("k").isNull())
    heads = rows.groupBy("block").agg(F.min(F.struct("z", "k", "h")).alias("head"))
    order, all_of = Window.orderBy("block"), Window.partitionBy()
    heads = heads.withColumn("to", F.coalesce(F.lag("block").over(order), F.max("block").over(all_of)))
    rows = rows.join(F.broadcast(heads), "block")
    here = F.struct(F.col("block").alias("at"), F.lit(False).alias("extra"))
    there = F.struct(F.col("to").alias("at"), F.lit(True).alias("extra"))
    is_head = F.struct("z", "k", "h").eqNullSafe(F.col("head"))
    rows = rows.withColumn("place", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here)))).select("*", "place.at", "place.extra")
    rows = rows.drop("block", "head", "to", "place").repartition("at").withColumns(derived or {})
    after = Window.partitionBy("at").orderBy("extra", "z", "k", "h")
    rows = rows.select("*", *[F.lead(c).over(after).alias(f"next_{c}") for c in carried]).where("NOT extra")
    return rows.drop("k", "h", "z", "at", "extra")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` with the signature set and the fingerprint."""
    return docs.withColumn("signatures", spot_signatures(text_of())).withColumn("fingerprint", fingerprint(F.col("signatures")))


def near_documents(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Documents grouped by fingerprint likeness: doc_id, component_id (smallest doc_id of its group).

    Equal sets are one class. A set of length n reaches ``least`` only with sets of length least * n to n / least,
    so it is sent to its own length class and the next, with its first n - ceil(least * n) + 1 signatures, the rarest
    first: two sets that reach ``least`` share one of them. Under each signature all classes are first compared with
    the smallest one and merged, then all that are still apart with each other, hot signatures in tiles, by the pruned
    Jaccard. So no pair is missed.
    """
    sets = docs.select("doc_id", spot_signatures(text_of()).alias("s")).withColumn("id", F.xxhash64("s"))
    classes = cut(sets.where(F.size("s") > 0).groupBy("id").agg(F.first("s").alias("s")).withColumn("n", F.size("s")))
    step = F.floor(F.log("n") / F.log(F.lit(1 / least)) + 1e-9)
    first = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1
    members = classes.select("id", "n", F.explode("s").alias("sig"))
    ranked = members.join(members.groupBy("sig").agg(F.count("*").alias("uses")).where("uses > 1"), "sig", "left")
    ranked = ranked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("uses", F.lit(1)).alias("uses"), "sig"))).alias("r"))
    prefixes = cut(ranked.select("id", "n", F.array(step, step + 1).alias("parts"), F.slice("r", F.lit(1), first.cast("int")).alias("r")))
    keys = prefixes.select("id", "n", F.explode("parts").alias("part"), "r").select("id", "n", "part", F.explode("r").alias("r"))
    keys = keys.where("r.uses > 1").select("id", "n", "part", "r.sig")
    centres = keys.groupBy("part", "sig").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").select("part", "sig", "a")
    pairs = keys.join(centres, ["part", "sig"]).where("id <> a").select("a", F.col("id").alias("b")).distinct()
    side = lambda c, s: classes.select(F.col("id").alias(c), F.col("s").alias(s))

    def good(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        return both.where(likeness(F.col("x"), F.col("y"), least) >= least).select("a", "b")

    merged = cut(components(good(pairs)))
    keys = keys.join(merged, "id", "left").withColumn("root", F.coalesce("component", "id")).drop("component")
    apart = keys.groupBy("part", "sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low <> high AND m > 2")
    apart = apart.select("part", "sig", F.ceil(F.col("m") / F.lit(TILE)).cast("int").alias("tiles"))
    keys = keys.join(apart, ["part", "sig"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    keys = keys.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile = ["part", "sig", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u")]
    one = keys.select(*tile, F.col("id").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    two = keys.select(*tile, F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    met = one.join(two, ["part", "sig", "t", "u"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= F.lit(least) * F.greatest("na", "nb") - 1e-9))
    rest = good(met.select("a", "b").distinct())
    linked = components(merged.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(rest))
    rows = sets.select("doc_id", "id", (F.size("s") == 0).alias("empty")).join(linked, "id", "left")
    rows = rows.withColumn("root", F.coalesce("component", "id"))
    names = rows.where("NOT empty").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    full = rows.where("NOT empty").join(names, "root").select("doc_id", "component_id")
    return full.unionByName(rows.where("empty").select("doc_id", F.col("doc_id").alias("component_id")))


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: n_chars, the edited text's digest, both fingerprints, and the likenesses."""
    docs = docs.select("doc_id", text_of().alias("text"))
    rows = with_next(docs, ["text", "signatures"], {"signatures": spot_signatures(F.col("text"))})
    n = F.char_length("text")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("moved", F.floor(n / F.lit(4)).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("moved")), F.substring(F.col("next_text"), F.lit(1), F.col("moved")))
    rows = rows.withColumn("edited", edited).withColumn("edited_signatures", spot_signatures(edited))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    )
