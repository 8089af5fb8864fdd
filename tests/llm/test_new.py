"""Hard negatives, toxicity and the divergence audit against brute force."""

import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from candlespark.llm import divergence, hard_negatives, toxicity
from candlespark.llm import queries as Q
from tests.llm.fixtures import empty, frame, texts

TABLES = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, row string, score double, size int, block long"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5, 1, 2) for r in rows], VECTORS).repartition(3)


def mined(rows, every=50):
    """All of it by loops over whole numbers; a row is its place in ``rows``."""
    usable = [(k, i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label) for k, (i, v, label) in enumerate(rows) if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for k, i, v, label in usable:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in usable if m != k and len(w) == len(v)]
        positives = sorted(s for s in scored if s[3] == label)[:5]
        for s, j, _, _ in positives:
            fits = sorted(t for t in scored if t[3] != label and 50 * -s <= 100 * -t[0] <= 95 * -s)[:3]
            out += [(i, j, n + 1, t[1], -s, -t[0]) for n, t in enumerate(fits)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in {"BLOCK": 16, "GROUP": 4, "TASK_ROWS": 64, "PIVOTS": 5, "AT_ONCE": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)


@pytest.mark.parametrize("kind", ["spread", "clusters", "copies"])
def test_hard_negatives_equal_brute_force(spark, small_parts, kind):
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.standard_normal((4, 6))
    for i in range(220):
        v = rng.standard_normal(6) if kind == "spread" else centres[i % 4] + 0.2 * rng.standard_normal(6) if kind == "clusters" else np.round(rng.standard_normal(6))
        rows.append((int(i), [float(x) for x in v], int(rng.integers(0, 3))))
    if kind == "copies":  # a third of all rows are one vector, an anchor's among them; rows come twice
        rows += [(i, rows[50][1], 1) for i in range(300, 400)] + [rows[50], rows[50], rows[3], (100, rows[50][1], 2)]
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (501, [1.0] * 6, None), (502, [1.0, float("nan")] + [1.0] * 4, 1), (503, [1.0, None] + [1.0] * 4, 1), (504, [float("inf")] * 6, 1), (550, [1.0, 2.0], 1), (551, [2.0, 2.0], 1), (552, [1.0, 1.5], 2), (600, [], 1), (601, [], 1), (650, [0.0] * 6, 1)]
    got = found(hard_negatives.mine(vectors(spark, rows)))
    assert got == mined(rows) and len(got) > 20


def test_hard_negatives_need_a_second_scan(spark, small_parts):
    """Anchors of a rare label: their positives lie far beyond the first radius."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], 9 if i in (50, 51, 52) else i % 3) for i in range(150)]
    assert found(hard_negatives.mine(vectors(spark, rows))) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors(spark, [])).count() == 0
    assert hard_negatives.mine(vectors(spark, [(1, [1.0], 1), (2, [2.0], 2)])).count() == 0  # no anchor
    assert hard_negatives.mine(vectors(spark, [(50, [1.0], 1)])).count() == 0


def test_scores_beyond_floating_point_are_exact_or_refused():
    a = np.array([[2.0**26 + 1, 1.0]])
    assert hard_negatives.product(a, a)[0, 0] == (2**26 + 1) ** 2 + 1
    with pytest.raises(ValueError):
        hard_negatives.product(np.array([[2.0**40]]), np.array([[2.0**40]]))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_source_divergence"])
def test_queries_equal_their_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(TABLES):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    df = Q.queries()[name](spark, TABLES)
    want = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())


# The audit


def audited(rows, min_docs=3, ranks=200):
    """All of it by loops."""
    import re

    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    seen, uses, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, words in docs:
        seen[lang].update(set(words))
        uses[lang, source].update(words)
    for lang in seen.keys() | {d[0] for d in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= min_docs)
        v = len(kept)
        sources = sorted(s for a, s in uses if a == lang)
        total = Counter()
        for s in sources:
            total.update({t: uses[lang, s][t] for t in kept})

        def part(c, v=v, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        q, p = part(total), {s: part(uses[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -x, n + 1) for n, (x, _, o) in enumerate(sorted(pairs))]
            out += [(lang, s, "term", t, -x, n + 1) for n, (x, _, t) in enumerate(sorted(terms)[:ranks])]
    return sorted(out)


def langs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 1.0, "x", 5, "y") for i, (lang, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, value long, p double, term string, at int, item string").repartition(4)


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ab", "Ção", "x'y", "DE", "日本", "zu-", "É") for b in "bcdfgh"]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = rng.choice(["s0", "s0", "s1", "s2", "é", None])
        rows.append((lang, source, " ".join(rng.choice(words[: 12 if source == "s0" else 40]) for _ in range(rng.randrange(0, 30)))))
    return rows + [("fr", "a", "einmal"), ("fr", "b", None), ("fr", "c", "123 ,,, 456"), ("it", "only", "una due"), ("en", "s9", ""), ("en", "s0", "ab " * 40_000)]


@pytest.mark.parametrize("few,ranks", [(0, 3), (2, 10), (2_000, 200)])
def test_audit_equals_brute_force(spark, few, ranks):
    rows = corpus()
    got = sorted(tuple(r) for r in divergence.audit(langs(spark, rows), ranks=ranks, few=few).collect())
    assert got == audited(rows, ranks=ranks) and len(got) > 100


def test_audit_with_blocks_of_pairs_and_flushed_counts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 6)  # fewer than a term's pairs of sources
    monkeypatch.setattr(divergence, "ENTRIES", 5)
    rows = corpus(4, 90)
    assert sorted(tuple(r) for r in divergence.audit(langs(spark, rows)).collect()) == audited(rows)


def test_audit_of_nothing_and_repeated_rows(spark):
    assert divergence.audit(langs(spark, [])).count() == 0
    rows = [("en", "a", "same words"), ("en", "b", "other words")] * 3
    assert sorted(tuple(r) for r in divergence.audit(langs(spark, rows)).collect()) == audited(rows)


def test_selection_breaks_ties_by_bytes(spark):
    rng = random.Random(1)
    rows = [("l", f"s{i % 3}", f"a long beginning that all share {j:04d}" if i % 2 else f"é{j}", rng.choice([0, 1, 5, 5, 5, 4096, 4097, 2**40, 2**59])) for i in range(3) for j in range(200)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    values = df.groupBy("lang", "source", "value").agg(F.count("*").alias("n"))
    for k, few in ((1, 0), (75, 0), (75, 30), (300, 0)):
        got = sorted((r.source, r["rank"], r["item"], r.value) for r in divergence.largest(df, values, k, few).collect())
        want = [(s, n + 1, r[2], r[3]) for s in ("s0", "s1", "s2") for n, r in enumerate(sorted((r for r in rows if r[1] == s), key=lambda r: (-r[3], r[2].encode()))[:k])]
        assert got == want


def test_parts_are_exact_for_large_counts(spark):
    cases = [(0, 1), (10**12, 3 * 10**12 + 7), (8 * 10**14, 8 * 10**15), (999, 1000), (5, 17)]
    df = spark.createDataFrame(cases, "u long, t long").select("u", "t", divergence.parts(F.col("u"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.u + 1) // r.t for r in df.collect())


# Toxicity


def labelled(seed=1, n=900):
    """Documents of three scripts, every sixth with words of a bad stem in between; labels for two thirds."""
    rng = random.Random(seed)
    plain = ["maru", "tolen", "siha", "kuvot", "brane", "дом", "лес", "река", "ñandú", "pelo", "gris", "vento"]
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [rng.choice(plain) + rng.choice("abcde") for _ in range(rng.choice([8, 40, 400]))]
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgu", "kripla", "мразю"]) + rng.choice(["", "nt", "ka", "rro"]))
        docs.append((i, " ".join(words), "s0"))
        if i % 3:
            labels.append((i, int(bad)))
        elif bad:
            labels.append((i, 1))
    return docs, labels


def truth(labels):
    return dict(labels)


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    docs, labels = labelled()
    frame_ = frame(spark, docs)
    label = spark.createDataFrame([(i, 0, t, "x") for i, t in labels] + [(None, 0, 1, "x"), (10**9, 0, 1, "x"), (3, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    rows = toxicity.score(frame_, toxicity.train(frame_, label)).collect()
    known = truth(labels)
    assert len(rows) == len(docs) and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(y for _, y in held) > 30
    assert sum(p and y for p, y in held) >= 0.95 * sum(y for _, y in held)  # recall
    assert sum(p and not y for p, y in held) <= 0.02 * sum(not y for _, y in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs, labels = labelled(2, 300)
    frame_ = frame(spark, docs)
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    turned = [(i, 1 - t if crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (toxicity.train(frame_, make(rows)) for rows in (labels, turned))
    assert a.at == b.at and np.array_equal(a.weights, b.weights) and a.bias == b.bias and a.prior == b.prior


def test_toxicity_odd_rows(spark):
    odd = frame(spark, texts())
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, toxic int")
    for labels in ([], [(0, 0), (1, 0)], [(0, 1), (2, 1)], [(0, 1), (0, 0), (5, 1), (7, 1), (58, 1)]):
        rows = toxicity.score(odd, toxicity.train(odd, label(labels))).collect()
        assert len(rows) == len(texts()) and all(r.score == r.score for r in rows)
        assert len({r.score for r in rows if r.doc_id in (58, 59)}) == 1  # null and empty text
        assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), label([(1, 1)]))).count() == 0


def test_the_risk_is_corrected_and_its_gradient_right():
    rng = np.random.default_rng(0)
    toxic, other = rng.integers(0, 2, (40, 5)).astype(float), rng.integers(0, 2, (60, 5)).astype(float)
    model = toxicity.PositiveUnlabelled([b"a", b"b", b"c", b"d", b"e"], 0.3)
    model.weights, model.bias = rng.standard_normal(5), 0.2
    loss = lambda z: np.log1p(np.exp(-z))
    g, h = toxic @ model.weights + 0.2, other @ model.weights + 0.2
    part, rest, up, down = model.risk(toxic, other)
    assert np.isclose(part, 0.3 * loss(g).mean()) and np.isclose(rest, loss(-h).mean() - 0.3 * loss(-g).mean())
    for k in range(6):
        step = 1e-6
        save = (model.weights.copy(), model.bias)
        if k < 5:
            model.weights[k] += step
        else:
            model.bias += step
        more = model.risk(toxic, other)
        model.weights, model.bias = save
        assert np.isclose((more[0] - part) / step, up[k], atol=1e-5) and np.isclose((more[1] - rest) / step, down[k], atol=1e-5)


def test_a_hot_document_is_sampled_once(spark):
    docs, labels = labelled(3, 120)
    rows = docs + [docs[6]] * 3_000  # one labelled document is most of the table
    sample = toxicity.sampled(frame(spark, rows).select("doc_id", "text"), 10**6)
    assert sample.count() == len(docs)
