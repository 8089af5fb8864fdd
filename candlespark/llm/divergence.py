"""Source divergence audit: how far the words of each source of a language are from those of its other sources, and which
words set it apart.

Texts are counted where they are read; counts of (lang, source, term) are shuffled, and each language keeps the terms of
``MIN_DOCS`` documents or more. A group's smoothed parts per thousand million of a term, p, and the part-wise divergence
f(p, q) = floor((p - q)^2 / q) are exact integers.

Sources against sources are a sparse product: a term that neither of two sources has adds the same baseline to their sum,
one that only one has adds an amount that depends on its own count alone, so these follow from histograms of counts; only
terms that both have are visited, term by term, and add what they differ from that baseline. Each task sums these in
blocks, so what is shuffled is a sum a pair of sources and block, not a row a pair and term.

The terms that set a group apart are found by radix selection: histograms over ``DIGIT`` bits of the values, from the
highest, give the bits of every group's k-th value; a value depends on two counts alone, so the histograms come from the
numbers of pairs of counts, and terms are read once, to take those beyond the k-th value. Ties at that value are told apart
by the UTF-8 bytes of their terms in the same way, ``BYTES`` at a time; groups with ``FEW`` ties at most need no such round.
No group is ever sorted whole: what is ranked are k rows and FEW more at most.

Defined cases: null text, lang and source are empty; repeated rows are documents of their own; null doc_ids don't matter; a
group without terms has its pairs all the same; a language whose terms are all rare has pairs of value 0; the only source
of a language has none; terms of any length are whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import cut, scratch_path, slices, small, table, text_of

#: Parts that probabilities are counted in, documents that a kept term is in, ranks of terms that are returned.
PARTS, MIN_DOCS, RANKS = 1_000_000_000, 3, 200
#: Bits of a value and bytes of a term that a round of the selection settles, and undecided rows of a group that need no round.
DIGIT, BYTES, FEW = 16, 8, 2_000
#: Entries of a task's counts, and pairs of sources that a task adds up at once.
ENTRIES, PAIRS = 300_000, 2_000_000


#: For bytes.translate: A-Z become a-z, and bytes of UTF-8 that are in no term become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """``docs(lang, source, text)`` to (lang, source, term, uses, docs), one row each."""
    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        held: dict = {}

        def out():
            for (lang, source), (uses, found) in held.items():
                n = len(uses)
                terms = pa.array(list(uses), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), terms, pa.array(list(uses.values()), pa.int64()), pa.array([found[t] for t in uses], pa.int64())],
                    names=["lang", "source", "term", "uses", "docs"],
                )
            held.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                words = text.encode().translate(LETTERS).split()
                uses, found = held.setdefault((lang, source), (Counter(), Counter()))
                uses.update(words)
                found.update(set(words))
            if sum(len(uses) for uses, _ in held.values()) > ENTRIES:
                yield from out()
        yield from out()

    rows = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    part = rows.mapInArrow(run, "lang string, source string, term string, uses long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The counts of terms that ``min_docs`` documents of their language have, with ``lang_uses``, ``first``, which is
    true in one row of a language's term, and ``shared``, true where other sources have it too; kept in the shared folder."""
    own = Window.partitionBy("lang", "term")
    rows = term_counts(docs).withColumns({"_docs": F.sum("docs").over(own), "lang_uses": F.sum("uses").over(own), "_sources": F.count("*").over(own), "_n": F.row_number().over(own.orderBy("source"))})
    path = scratch_path(docs.sparkSession, "terms")
    rows.where(F.col("_docs") >= min_docs).select("lang", "source", "term", "uses", "lang_uses", (F.col("_n") == 1).alias("first"), (F.col("_sources") > 1).alias("shared")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def parts(uses: Column, total: Column) -> Column:
    """1 + floor(PARTS * (uses + 1) / total) in long arithmetic, by long division to base 1000 (total under 9e15)."""
    rest, found = uses + 1, F.lit(0).cast("long")
    for _ in range(3):
        found, rest = found * 1000 + F.call_function("div", rest * 1000, total), rest * 1000 % total
    return found + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def combinations(kept: DataFrame) -> DataFrame:
    """How often each pair of a term's counts (in its group, in its language) occurs in a group: all that the groups' sums,
    the baselines and the histograms of values need, in far fewer rows than there are terms."""
    return cut(kept.groupBy("lang", "source", "uses", "lang_uses").agg(F.count("*").alias("m"), F.count_if("first").alias("kinds")))


def sources_of(docs: DataFrame, combos: DataFrame) -> DataFrame:
    """(lang, source, at, total, zero, terms, kinds, lang_total): a row a group, ``at`` its number from 0 among its language's
    sources, ``total`` the divisor of its parts, ``zero`` the parts of a term it doesn't have, ``terms`` how many it has,
    ``kinds`` how many its language keeps. Numbered by a window a language: sources are a dimension."""
    found = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source")).distinct()
    sums = combos.groupBy("lang", "source").agg(F.sum(F.col("uses") * F.col("m")).alias("n"), F.sum("m").alias("terms"), F.sum("kinds").alias("own_kinds"))
    per = sums.groupBy("lang").agg(F.sum("own_kinds").alias("kinds"), F.sum("n").alias("lang_n"))
    rows = found.join(sums, ["lang", "source"], "left").join(per, "lang", "left").na.fill(0, ["n", "terms", "kinds", "lang_n"])
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    total = F.greatest(F.col("n") + F.col("kinds"), F.lit(1))  # nothing is divided by 0; without terms no parts are used
    rows = rows.select("lang", "source", at.alias("at"), total.alias("total"), "terms", "kinds", (F.col("lang_n") + F.col("kinds")).alias("lang_total"))
    return cut(rows.withColumn("zero", parts(F.lit(0).cast("long"), F.col("total"))))


def shared_terms(rows: DataFrame) -> DataFrame:
    """``rows(lang, term, at, p, zero)`` to (lang, at, other, more): over the terms that two sources both have, the sum of
    what their parts add beyond the three baselines."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        f = lambda p, q: (p - q) * (p - q) // q

        def block(lang, own, at, p, zero):
            """Adds up terms (rows) over the pairs of their sources (columns), the first of a pair out of ``own``."""
            a, b = at[:, own, None], at[:, None, :]
            x, y, u, v = p[:, own, None], p[:, None, :], zero[:, own, None], zero[:, None, :]
            more = f(x, y) - f(x, v) - f(u, y) + f(u, v)
            keys, back = np.unique((a << 32) + b, return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, back.ravel(), more.ravel())
            whole = held.setdefault(lang, {})
            for key, value in zip(keys.tolist(), sums.tolist()):
                whole[key] = whole.get(key, 0) + value

        def split(lang, at, p, zero):
            """Terms that ``at.shape[1]`` sources have, PAIRS pairs at a time."""
            wide = at.shape[1]
            step, few = max(1, PAIRS // (wide * wide)), max(1, PAIRS // wide)
            for k in range(0, len(at), step):
                for j in range(0, wide, few):
                    block(lang, slice(j, j + few), *(x[k : k + step] for x in (at, p, zero)))

        def out():
            for lang, sums in held.items():
                keys = np.fromiter(sums, dtype=np.int64, count=len(sums))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(keys), pa.string()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(list(sums.values()), pa.int64())],
                    names=["lang", "at", "other", "more"],
                )
            held.clear()

        held: dict = {}
        for batch in batches:
            lengths = batch.column("held").value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column("held").flatten()
            at, p, zero = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            starts = np.cumsum(lengths) - lengths
            langs, which = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            for k, lang in enumerate(langs):
                for wide in np.unique(lengths[which == k]).tolist():
                    if wide > 1:
                        pick = starts[(which == k) & (lengths == wide)][:, None] + np.arange(wide)
                        split(lang, at[pick], p[pick], zero[pick])
            if sum(map(len, held.values())) > PAIRS:
                yield from out()
        yield from out()

    each = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p", "zero")).alias("held"))
    part = each.select("lang", "held").mapInArrow(run, "lang string, at int, other int, more long").where("at <> other")
    return part.groupBy("lang", "at", "other").agg(F.sum("more").alias("more"))


def pairs(rows: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): every other source of a source's language. ``rows(lang, term, at, p, zero)`` are the terms
    that sources share, ``own(lang, at, p, m)`` how often a source has which parts."""
    mine = groups.select("lang", "source", "at", F.col("zero").alias("z"), "terms", "kinds")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("other"), F.col("zero").alias("y"), F.col("terms").alias("their_terms"))
    both = mine.join(small(theirs), "lang").where("at <> other")
    base = (F.col("kinds") - F.col("terms") - F.col("their_terms")) * apart(F.col("z"), F.col("y"))
    zeros = groups.select("lang", F.col("at").alias("_at"), F.col("zero").alias("_zero"))
    alone = own.join(small(zeros), "lang").where("at <> _at")
    first = alone.groupBy("lang", "at", F.col("_at").alias("other")).agg(F.sum(F.col("m") * apart(F.col("p"), F.col("_zero"))).alias("first"))
    second = alone.groupBy("lang", F.col("_at").alias("at"), F.col("at").alias("other")).agg(F.sum(F.col("m") * apart(F.col("_zero"), F.col("p"))).alias("second"))
    key = ["lang", "at", "other"]
    whole = both.join(first, key, "left").join(second, key, "left").join(shared_terms(rows), key, "left").na.fill(0, ["first", "second", "more"])
    value = F.when(F.col("kinds") > 0, base + F.col("first") + F.col("second") + F.col("more")).otherwise(0)
    return whole.select("lang", "source", "item", value.alias("value"))


def settled(counts: DataFrame, digit: Column, descending: bool) -> DataFrame:
    """One round of the selection, of ``counts(lang, source, sought, n)`` with a digit: per group the digit that the row sought
    lies in, which of that digit's rows it is, and how many those are."""
    group = ["lang", "source"]
    sums = counts.groupBy(*group, "sought", digit.alias("digit")).agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy(F.desc("digit") if descending else F.asc("digit"))) - F.col("n")
    at = sums.withColumn("before", before).where("before < sought AND before + n >= sought")
    return at.select(*group, "digit", (F.col("sought") - F.col("before")).alias("inside"), F.col("n").alias("inside_n"))


def largest(rows: DataFrame, values: DataFrame, k: int, few: int = FEW) -> DataFrame:
    """``rows(lang, source, item, value)`` to the ``k`` of each group of (lang, source) with the largest values (0 to 2^60), ties
    by UTF-8 bytes, by radix selection; ``values(lang, source, value, n)`` are the rows' values with their numbers. The items of
    a group differ. ``rows`` are read once."""
    group = ["lang", "source"]
    values = cut(values)
    sizes = values.groupBy(*group).agg(F.sum("n").alias("size"), F.max("value").alias("top"))
    facts = cut(sizes.select(*group, F.lit(0).cast("long").alias("low"), F.least(F.lit(k), "size").cast("long").alias("sought"), "size", "top"))
    shift = int(facts.agg(F.max("top")).first()[0] or 0).bit_length()
    while shift > 0:
        above, shift = shift, max(0, shift - DIGIT)
        left = values.join(small(facts), group).where(F.shiftright("value", above) == F.shiftright("low", above))
        found = settled(left, F.shiftright("value", shift), True)
        facts = cut(facts.join(small(found), group).select(*group, F.shiftleft("digit", shift).alias("low"), F.col("inside").alias("sought"), F.col("inside_n").alias("size"), "top"))
    raw, tied, at = F.col("item").cast("binary"), F.col("value") == F.col("low"), 0
    near = rows.join(small(facts.select(*group, "low")), group).where(F.col("value") >= F.col("low"))
    near = cut(near.withColumns({"raw": raw, "tied": tied}).drop("low"))
    facts = facts.select(*group, "sought", "size", F.lit("").cast("binary").alias("start"))
    while not (open_ := facts.where((F.col("size") > few) & (F.col("size") > F.col("sought")))).isEmpty():
        left = near.join(small(open_), group).where(F.col("tied") & (F.substring("raw", 1, at) == F.col("start"))).withColumn("n", F.lit(1))
        at += BYTES
        found = settled(left, F.substring("raw", 1, at), False)
        facts = facts.join(small(found), group, "left")
        facts = cut(facts.select(*group, F.coalesce("inside", "sought").alias("sought"), F.coalesce("inside_n", "size").alias("size"), F.coalesce("digit", "start").alias("start")))
    # of the ties, those up to the settled bytes are enough
    near = near.join(small(facts.select(*group, "start")), group).where(~F.col("tied") | (F.length("start") == 0) | (F.substring(F.col("raw"), F.lit(1), F.length("start")) <= F.col("start")))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "raw"))
    return near.select(*group, "item", "value", rank.alias("rank")).where(F.col("rank") <= k)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS, few: int = FEW) -> DataFrame:
    """``docs(lang, source, text)`` to (lang, source, part, item, value, rank)."""
    kept = kept_terms(docs, min_docs)
    combos = combinations(kept)
    groups = sources_of(docs, combos)
    facts = small(groups.select("lang", "source", "at", "total", "zero", "lang_total"))
    p, q = parts(F.col("uses"), F.col("total")), parts(F.col("lang_uses"), F.col("lang_total"))
    above = lambda rows: rows.join(facts, ["lang", "source"]).withColumns({"p": p, "q": q}).where("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
    values = above(combos).groupBy("lang", "source", "value").agg(F.sum("m").alias("n"))
    terms = largest(above(kept).select("lang", "source", F.col("term").alias("item"), "value"), values, ranks, few).withColumn("part", F.lit("term"))
    own = combos.groupBy("lang", "source", "uses").agg(F.sum("m").alias("m")).join(facts, ["lang", "source"]).select("lang", "at", p.alias("p"), "m")
    shared = kept.where("shared").join(facts, ["lang", "source"]).select("lang", "term", "at", p.alias("p"), "zero")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("item").cast("binary"))
    both = pairs(shared, own, groups).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return both.select(*columns).unionByName(terms.select(*columns))


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The audit of the whole documents table."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
u AS (SELECT n, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lc FROM u GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
c AS (SELECT u.lang, u.source, u.term, count(*) AS c FROM u JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v, sum(lc)::BIGINT AS ln FROM kept GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(v.v, 0) AS v, coalesce(v.ln, 0) AS ln, coalesce((SELECT sum(c) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0)::BIGINT AS n
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + g.v) AS p, 1 + 1000000000 * (k.lc + 1) // (g.ln + g.v) AS q
      FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(pv.value, 0)::BIGINT AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN pv ON pv.lang = g.lang AND pv.source = g.source AND pv.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS k FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, k::INTEGER AS rank FROM r WHERE part = 'pair' OR k <= 200
"""
