import hashlib
import os
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from pyspark.sql import functions as F

from candlespark.llm import common, embedding_dedup, fingerprints, line_dedup, ngram_join, shingles
from tests.llm.fixtures import empty, frame, texts


def union_find(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        p[find(a)] = find(b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5400)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    roots = union_find(6000, edges)
    least = {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert got == {i: least[roots[i]] for e in edges if e[0] != e[1] for i in e}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_set(t, size=5):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def test_shingle_hashes_stand_for_word_sets():
    rows = [(t or "").encode() for _, t, _ in texts()] + [b"a b", b"a  B", b"ab", b"a\x0bb", b"a\xc2\xa0b"]
    sets = list(shingles.shingle_sets(rows, 5))
    exact = [word_set(t.decode()) for t in rows]
    assert [len(s) for s in sets] == [len(s) for s in exact]
    for i in range(len(rows)):
        for j in range(0, len(rows), 7):
            assert len(np.intersect1d(sets[i], sets[j])) == len(exact[i] & exact[j])


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_brute_force(spark, seed):
    rows = texts(seed)
    sets = [word_set(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    roots, least = union_find(len(rows), links), {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[i][0])
    want = sorted((str(rows[i][0]), len(sets[i]), str(least.get(roots[i]))) for i in range(len(rows)))
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    kept = ngram_join.first_of_groups(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    groups = {roots[i] for i in range(len(rows)) if sets[i]}
    assert kept.count() == len(groups) + sum(not s for s in sets)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_join(empty(spark)).count() == 0 and ngram_join.first_of_groups(empty(spark)).count() == 0


def test_line_dedup_against_brute_force(spark):
    rows = [r for r in texts() if r[0] != 7] + [(7, texts()[7][1], "s")]
    occurrences = {}
    for d, t, _ in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            n = line_dedup.normal(line)
            if len(n) >= 10:
                occurrences.setdefault(n, []).append((d is None, d or 0, i))
    lines = list(occurrences)
    sets = [frozenset(x[i : i + 7] for i in range(len(x) - 6)) for x in lines]
    roots = union_find(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    gone = {}
    for r in set(roots):
        places = sorted(o for i, line in enumerate(lines) if roots[i] == r for o in occurrences[line])
        for _, d, i in places[1:]:
            gone.setdefault(d, set()).add(i)
    docs = frame(spark, rows)
    out = line_dedup.deduplicate(docs)
    assert out.columns == [*docs.columns, "_lines", "_gone"]
    got = {r.doc_id: (r.text, set(r._gone)) for r in out.collect()}
    for d, t, _ in rows:
        lost = gone.get(d or 0, set()) if d is not None else set()
        assert got[d] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost), lost)
    left = line_dedup.without_repeats(docs)
    assert {r.doc_id for r in left.collect()} == {d for d, (t, lost) in got.items() if not lost or (t or "").strip()}
    assert line_dedup.deduplicate(empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [2_000, 20])
def test_line_dedup_of_template_lines(spark, monkeypatch, tile):
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(3):  # a shared phrase with variable parts, and near copies of them
        phrase = letters(200)
        for _ in range(60):
            variable = letters(30)
            lines += [f"{phrase} {variable}", f"{phrase} {variable[:-20]}{letters(20)}"]
    sets = [frozenset(x[i : i + 7] for i in range(len(x) - 6)) for x in lines]
    keys = [set(k) for k in line_dedup.band_keys(lines, 7).tolist()]
    roots = union_find(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if keys[i] & keys[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.deduplicate(docs).collect() if r._gone}
    assert got == {i for i in range(len(lines)) if any(roots[j] == roots[i] for j in range(i))} and len(got) > 150


def vectors(seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    for i in range(300, 420):
        base = np.array(rows[i % 5][1])
        rows.append((i, (base + rng.standard_normal(16) * rng.uniform(0, 0.4) * np.linalg.norm(base) / 4).tolist()))
    rows += [(420, None), (421, []), (422, [0.0] * 16), (423, [float("nan")] + [1.0] * 15), (424, [float("inf")] + [1.0] * 15), (425, [None] + [1.0] * 15)]
    rows += [(426, rows[3][1]), (426, rows[3][1]), (427, rows[3][1]), (428, rows[0][1][:8]), (None, rows[0][1]), (429, [x * 1e-3 for x in rows[9][1]])]
    return rows


@pytest.mark.parametrize("tile", [10_000, 25])
def test_embedding_links_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    monkeypatch.setattr(embedding_dedup, "CELL", 64 if tile > 25 else 16)
    rows = vectors()
    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    links = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95]
    count, roots = [0] * len(rows), union_find(len(rows), links)
    for i, j in links:
        count[i] += 1
        count[j] += 1
    want = sorted((str(d), count[i], str(min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i] and rows[j][0] is not None), default=None))) for i, (d, _) in enumerate(rows))
    df = spark.createDataFrame([(d, v, 1, 2, "x") for d, v in rows], "vec_id long, embedding array<double>, label long, id long, cell string")
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_collisions_are_counted_over_rounds(spark):
    rows = [(1, 0.0, 5), (1, 0.4, 6), (2, 0.0, 5), (2, 0.5, 6), (2, 1.2, 7), (3, 0.0, 5), (3, 0.1, 7)]  # 5 and 6 meet twice, 5 and 7 once
    df = spark.createDataFrame(rows, "cell long, value float, id long")
    assert [tuple(r) for r in embedding_dedup.collisions(df, 0.5).collect()] == [(5, 6)]


def test_collision_plan_keeps_the_chance_to_miss_low():
    for n in (0, 1, 1_000, 10**6, 10**9):
        rounds, bits, half = embedding_dedup.plan(n)
        assert embedding_dedup.LEAST <= rounds < 256 and n / 2**bits < 20


def test_planted_links_just_above_the_threshold_are_found(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((50_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((4_000, 32))
    side -= (side * x[:4_000]).sum(1, keepdims=True) * x[:4_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.96, (4_000, 1))
    near = c * x[:4_000] + np.sqrt(1 - c * c) * side
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(54_000), "embedding": [v.tolist() for v in np.concatenate([x, near])]}), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).where("vec_id >= 50000").collect()}
    found = sum(got[50_000 + i] == i for i in range(4_000))
    print("planted links found", found)
    assert found >= 3_994  # 0.8 lost ones are expected


def test_fingerprints(spark):
    rows = [r for r in texts() if r[0] != 7]
    docs = frame(spark, rows)
    out = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert out[52].fingerprint == out[5].fingerprint == out[57].fingerprint and out[0].fingerprint != out[1].fingerprint
    assert out[58].fingerprint == out[59].fingerprint == out[60].fingerprint == "0:"
    near = fingerprints.near_documents(docs).collect()
    parts = {r.doc_id: r.component_id for r in near}
    assert all(parts[i] == 5 for i in range(52, 58)) and parts[41] == parts[40] == 0 and parts[3] == 3 and parts[58] == 58
    assert fingerprints.near_documents(empty(spark)).count() == 0


def spots(text):
    """The rule of the signatures, over words instead of hashes."""
    words = [w for w in regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split(" ") if w and w not in fingerprints.SKIPPED]
    chain, out = "", []
    for w in words:
        if w in fingerprints.ANCHORS:
            chain += w + ">"
        else:
            out.append((chain, w))
            chain = ""
    if chain:
        out.append((chain, ""))
    after = [w for _, w in out[1:]] + [""]
    return {("*", w, n) for (_, w), n in zip(out, after)} | {(c, w, n) for (c, w), n in zip(out, after) if c}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def expected_edits(rows):
    """op6's result for (doc_id, text) rows in order."""
    out = []
    for (d, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        moved = len(text) // 4
        edited = text[: len(text) - moved] + following[:moved]
        out.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(spots(text), spots(edited)), alike(spots(text), spots(following))))
    return out


@pytest.mark.parametrize("block", [2_000, 3])
def test_edited_fingerprints_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rows = sorted((d, t or "") for d, t, _ in texts() if d is not None and d != 7 and "İ" not in (t or ""))  # one order, and one rule of lower case
    rows = [(d * (10**9 if d > 40 else 1), t) for d, t in rows] + [(None, "at the end of all, a text without id")]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k long, block string").repartition(5)).collect()}
    assert len(got) == len(rows)
    for d, n, sha, edited, following in expected_edits(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, sha) and abs(r.near_edited - edited) < 1e-9 and abs(r.near_next - following) < 1e-9


def test_rows_without_id_and_of_one_id_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK", 10)
    monkeypatch.setattr(fingerprints, "CELLS", 8)
    rows = [(None, f"null {i}") for i in range(300)] + [(5, f"five {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300)]
    keys = spark.createDataFrame(rows, "k long, text string").withColumn("h", F.xxhash64("text"))
    column, most = fingerprints.blocks(keys)
    sizes = [r["count"] for r in keys.groupBy(column.alias("b")).count().collect()]
    assert max(sizes) < 60 and len(sizes) <= most
    ordered = [tuple(r) for r in keys.select(column.alias("b"), F.col("k").isNull().alias("z"), "k", "h").orderBy("z", "k", "h").collect()]
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)
    got = fingerprints.edited_fingerprints(keys.select(F.col("k").alias("doc_id"), "text")).collect()
    assert len(got) == 900


def test_edits_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the driver's tables")
    sql = f"""SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, CAST(length(t) - length(t) // 4 AS BIGINT)) || substr(n, 1, CAST(length(t) // 4 AS BIGINT))) AS edited_sha256
      FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first(coalesce(text, '')) OVER (ORDER BY doc_id)) AS n FROM '{folder}/documents.parquet')"""
    want = sorted(duckdb.sql(sql).fetchall())
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.op6_fingerprints(spark, folder).collect()) == want


def test_fingerprints_have_no_border_of_length(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcfghjkmnprtvw") for _ in range(6))
    rows = []
    for chars in (200, 1_000):  # two texts that differ by their last word, one on either side
        text = " ".join(("the " if rng.random() < 0.3 else "") + word() for _ in range(chars // 5))
        cut_at = text.rindex(" ", 0, chars - 1)
        rows.append((text[:cut_at], text[:cut_at] + " " + "x" * (chars + 2 - cut_at)))
    rows.append(("a " * 5 + "word " * 4 + "of " + " ".join(word() for _ in range(220)), ""))  # few anchors, and one more
    rows[-1] = (rows[-1][0], rows[-1][0] + " the " + " ".join(f"the {word()}" for _ in range(8)))
    pairs = spark.createDataFrame(rows, "a string, b string")
    near = pairs.select(fingerprints.likeness(fingerprints.spot_signatures(F.col("a")), fingerprints.spot_signatures(F.col("b"))))
    assert all(len(a) < n <= len(b) for (a, b), n in zip(rows, (200, 1_000)))
    assert all(r[0] >= 0.9 for r in near.collect())


@pytest.mark.parametrize("tile", [2_000, 8])
def test_near_documents_of_hot_signatures(spark, monkeypatch, tile):
    monkeypatch.setattr(fingerprints, "TILE", tile)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    shared = [word() for _ in range(80)]  # a passage of all documents
    rows = []
    for _ in range(25):
        own = [word() for _ in range(30)]
        rows += [" ".join(shared + own), " ".join(shared + own[:-8] + [word() for _ in range(8)])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    sets = {r.doc_id: set(r.signatures) for r in fingerprints.fingerprints(docs).collect()}
    links = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    roots, least = union_find(len(rows), links), {}
    for i, r in enumerate(roots):
        least.setdefault(r, i)
    assert len(least) == 25
    assert {r.doc_id: r.component_id for r in fingerprints.near_documents(docs).collect()} == {i: least[r] for i, r in enumerate(roots)}


def test_next_document_and_edit(spark):
    rows = sorted(((i * 37 % 101, f"text {i} " + "word " * (i % 9)) for i in range(101)), key=lambda r: r[0]) + [(None, "nothing"), (10**15, None), (10**15 + 5, "far")]
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))).repartition(4)
    old = fingerprints.BLOCK
    fingerprints.BLOCK = 3
    try:
        got = {r.doc_id: r.next_text for r in fingerprints.with_next(df, ["text"]).collect()}
    finally:
        fingerprints.BLOCK = old
    assert got == {d: ordered[(i + 1) % len(ordered)][1] or "" for i, (d, _) in enumerate(ordered)}
    assert fingerprints.with_next(df.limit(0), ["text"]).count() == 0
    one = df.where("doc_id = 0")
    assert one.count() == 1 and fingerprints.with_next(one, ["text"]).first().next_text == one.first().text


def test_likeness(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([1], [1, 2, 3, 4, 5])], "a array<long>, b array<long>")
    assert [r[0] for r in rows.select(fingerprints.likeness(F.col("a"), F.col("b"), 0.3)).collect()] == [0.5, 1.0, 0.0, 0.0]


def test_lines_of_plain_texts_have_their_normal_form():
    from candlespark.llm import line_dedup

    texts = ["", " ", "a  B c\n x \n\nY z  ", "A\tb\n c", "\x1cA b\nc", "Σας ΟΔΟΣ\nΣ  x", "a\x0bb c\r\nd", "É  f g\n h"]
    assert [line_dedup.normal_lines(t) for t in texts] == [[line_dedup.normal(x) for x in t.split("\n")] for t in texts]


def test_keys_with_the_same_lines_are_compared_once(spark, monkeypatch):
    """Three lines under eight equal keys: one of the keys' rows go to the tiles, and the links are all there."""
    import struct

    from candlespark.llm import line_dedup

    text = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dogs", "something else entirely, not like the others"]
    lines = spark.createDataFrame([(i, bytearray(struct.pack("<8q", *range(8)))) for i in range(3)], "line long, keys binary")
    content = spark.createDataFrame([(i, 0, t) for i, t in enumerate(text)], "line long, more int, content string")
    merged = spark.createDataFrame([], "line long, component long")
    broadcast = []
    monkeypatch.setattr(line_dedup, "small", lambda df: broadcast.append(df) or df)
    found = line_dedup.remaining(lines, merged, content, line_dedup.SHINGLE, line_dedup.PERCENT)
    assert broadcast[-1].columns == ["key", "parts"] and broadcast[-1].count() == 1
    assert [sorted(r) for r in found.collect()] == [[0, 1]]


def test_line_candidates_are_shuffled_in_packed_buckets(spark, monkeypatch):
    from candlespark.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BUCKET", 64)
    monkeypatch.setattr(line_dedup, "GATHER", 50)
    rng = random.Random(3)
    keys = [[rng.randrange(-400, 400) for _ in range(line_dedup.BANDS)] for _ in range(600)]
    rows = [(i - 300, np.array(k, dtype=np.int64).tobytes()) for i, k in enumerate(keys)] + [(1000, None)]
    pairs = line_dedup.candidate_stars(spark.createDataFrame(rows, "line long, keys binary").repartition(5))
    got = [(r.a, r.b) for r in pairs.collect()]
    under = {}
    for i, k in enumerate(keys):
        for x in k:
            under.setdefault(x, set()).add(i - 300)
    assert len(set(got)) == len(got) and all(a < b for a, b in got)
    assert all(any(a in u and b in u for u in under.values()) for a, b in got)  # of lines that share a key
    found = union_find(600, [(a + 300, b + 300) for a, b in got])
    assert all(len({found[x + 300] for x in lines}) == 1 for lines in under.values())  # and a key's lines are linked through such pairs
    assert "packed" in pairs._jdf.queryExecution().toString()
    assert line_dedup.candidate_stars(spark.createDataFrame([], "line long, keys binary")).count() == 0


def test_line_contents_come_from_one_document_each(spark):
    from candlespark.llm import line_dedup

    rows = [(i, "\n".join(f"  Line {k} \t of the {'odd' if k % 2 else 'even'} ones" for k in range(i, i + 5))) for i in range(30)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumn("dk", F.xxhash64("doc_id", "text")).repartition(3)
    lines = common.cut(line_dedup.line_table(docs, 10, 7))
    known = {line_dedup.digest(x): x for _, t in rows for x in line_dedup.normal_lines(t)}
    some = sorted(d[0] for d in known)[:12]
    asked = spark.createDataFrame([(some[0], x) for x in some[1:]], "a long, b long")
    got = line_dedup.contents(asked, lines, docs).collect()
    assert sorted(r.line for r in got) == some and all(known[r.line, r.more] == r.content for r in got)


def test_lines_with_other_white_space_are_split_into_words():
    from candlespark.llm import line_dedup

    odd = [c for c in map(chr, range(0x110000)) if c.isspace() and c not in " \n"]
    texts = [f"Élan{c} İX  ΑΣ\n ΣΑΣ{c}\n{c}" for c in odd] + ["ÉLAN ΑΣ\nΣ ß  İ \n", "ΑΣ", "\n", ""]
    assert sorted(odd) == sorted(line_dedup.ODD_SPACE)
    assert [line_dedup.normal_lines(t) for t in texts] == [[line_dedup.normal(x) for x in t.split("\n")] for t in texts]


def test_band_keys_follow_from_each_line_alone():
    from candlespark.llm import line_dedup

    rng = random.Random(8)
    lines = ["".join(rng.choice("abcé ") for _ in range(n)) for n in [7, 8, 13, 14, 40, 7, 7, 31_000, 9, 200]]
    alone = [line_dedup.band_keys([x], 7)[0].tolist() for x in lines]
    assert line_dedup.band_keys(lines, 7).tolist() == alone
