"""Toxicity by non-negative positive-unlabelled learning.

What is confirmed are toxic documents; everything else is unlabelled, as a text that nobody marked may be toxic too. A linear
logistic classifier is trained in numpy on the risk that the class prior corrects,

    prior * E_toxic[l(g)] + max(0, E_unlabelled[l(-g)] - prior * E_toxic[l(-g)]),   l(z) = log(1 + exp(-z)),

in mini-batches; where a batch's second term is negative, which only overfitting makes it, the step goes up that term instead.
The prior is the share of toxic documents among the labelled ones that may be learnt from, or a parameter; labels of other
documents are used for nothing else.

The cut, too, comes from toxic and unlabelled documents alone: it makes recall^2 / share of unlabelled documents beyond it
largest, and is moved to a score of 0.7.

A document's features are whether it holds any of ``FEATURES`` words or beginnings of words (4 to 6 bytes of UTF-8). Chosen are
those that likelihood ratios tell apart (``SURE``) and whose unlabelled uses the prior leaves to toxic documents in the main
(``PURE``). Words are runs of ASCII letters and of characters beyond ASCII, A-Z
lower-cased. A script without spaces between words offers only whole runs and their beginnings.

Feature counts are aggregated by Spark over a hash sample of about ``TOXIC_ROWS`` confirmed and ``UNLABELLED_ROWS`` unlabelled
documents, equal rows once; the chosen features of these alone come to the driver, where the weights are fitted. All
documents are scored, over their whole texts.

Defined cases: null text scores as the empty text; a document labelled more than once is toxic if half its labels or more are;
null labels, labels of unknown documents and null doc_ids teach nothing; null doc_ids are never held out; without a
confirmed document every score is the prior (0 without labels); repeated rows each get a score; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import cut, doc_key, slices, small, table, text_of
from candlespark.llm.divergence import LETTERS

THRESHOLD = 0.7
#: Sampled documents, features, and documents of the toxic sample that a feature is in at least; least likelihood ratio (G) of
#: a feature, and the least share of toxic ones that the prior gives its unlabelled documents.
TOXIC_ROWS, UNLABELLED_ROWS, FEATURES, LEAST, SURE, PURE = 8_000, 16_000, 1_024, 3, 12.0, 0.8
#: Bytes of the beginnings of words that are features; entries of a task's counts, words that a task remembers.
HEADS, ENTRIES, MEMO = (4, 5, 6), 300_000, 200_000


def features_of(word: bytes) -> list[bytes]:
    """The features that a word stands for: itself, and its beginnings, marked."""
    return [word, *(word[:n] + b"*" for n in HEADS if len(word) > n)]


class PositiveUnlabelled:
    """A logistic classifier over the presence of chosen words and beginnings of words."""

    def __init__(self, features: list[bytes], prior: float, epochs: int = 100, batches: int = 8, rate: float = 0.05, decay: float = 1e-4):
        import numpy as np

        self.at = {f: k for k, f in enumerate(features)}
        self.prior, self.epochs, self.batches, self.rate, self.decay = prior, epochs, batches, rate, decay
        prior = min(max(prior, 1e-6), 1 - 1e-6) if prior else 0.0
        self.weights, self.bias = np.zeros(len(features)), float(np.log(prior / (1 - prior))) if prior else -np.inf

    def risk(self, toxic, other):
        """Of two 0/1 matrices: the toxic part of the risk and the rest, and the gradients of both (weights, then bias)."""
        import numpy as np

        g, h = toxic @ self.weights + self.bias, other @ self.weights + self.bias
        loss = lambda z: np.logaddexp(0, -z)
        s, t = 1 / (1 + np.exp(-g)), 1 / (1 + np.exp(-h))
        part = self.prior * loss(g).mean()
        rest = loss(-h).mean() - self.prior * loss(-g).mean()
        slope = lambda x, v: np.append(v @ x, v.sum()) / len(v)
        return part, rest, self.prior * slope(toxic, s - 1), slope(other, t) - self.prior * slope(toxic, s)

    def fit(self, toxic, other):
        """Fits the weights to 0/1 matrices of confirmed and of unlabelled documents, by Adam."""
        import numpy as np

        if not len(toxic) or not len(other) or not self.at:
            return self
        toxic, other = toxic.astype(np.float32), other.astype(np.float32)
        rng = np.random.default_rng(7)
        first, second, step = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1), 0
        for _ in range(self.epochs):
            a, b = rng.permutation(len(toxic)), rng.permutation(len(other))
            for i, j in zip(np.array_split(a, min(self.batches, len(a))), np.array_split(b, min(self.batches, len(a))), strict=True):
                _, rest, up, down = self.risk(toxic[i], other[j])
                slope = up + down if rest >= 0 else -down
                slope[:-1] += self.decay * self.weights
                step += 1
                first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
                move = self.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                self.weights, self.bias = self.weights - move[:-1], self.bias - move[-1]
        g, h = toxic @ self.weights + self.bias, other @ self.weights + self.bias
        cuts = np.unique(np.concatenate([g, h]))
        share = lambda v: 1 - np.searchsorted(np.sort(v), cuts) / len(v)
        best = int((share(g) ** 2 / np.maximum(share(h), 1 / len(h))).argmax())
        self.bias += np.log(THRESHOLD / (1 - THRESHOLD)) - (cuts[best] + cuts[max(best - 1, 0)]) / 2
        return self

    def found(self, text: str, memo: dict) -> list[int]:
        """Numbers of the features in a whole text, in order. ``memo`` holds those of words already seen."""
        held = set()
        for word in set(text.encode().translate(LETTERS).split()):
            own = memo.get(word)
            if own is None:
                own = memo[word] = tuple(self.at[f] for f in features_of(word) if f in self.at)
                if len(memo) > MEMO:
                    memo.clear()
            held.update(own)
        return sorted(held)

    def score(self, texts: list[str], memo: dict):
        """Scores in 0..1 of whole texts."""
        import numpy as np

        g = np.array([self.bias + self.weights[self.found(t, memo)].sum() for t in texts], dtype=float)
        return 1 / (1 + np.exp(-np.clip(g, -700, 700)))


def sampled(rows: DataFrame, n: int) -> DataFrame:
    """About ``n`` different rows of (doc_id, text), by their hash."""
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    there = rows.agg(F.approx_count_distinct("h")).first()[0]
    if there > n:
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * n / there))
    return rows.dropDuplicates(["h"]).select("h", "text")


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", prior: float | None = None, toxic_rows: int = TOXIC_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> PositiveUnlabelled:
    """Fits the classifier; learns no labels of rows whose crc32(doc_id) leaves 1 by 3."""
    import numpy as np

    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (doc_key(labels) % 3 != 1))
    known = known.groupBy("doc_id").agg((F.avg(F.col(column).cast("double")) >= 0.5).alias("toxic"))
    facts = known.agg(F.count("*").alias("n"), F.count_if("toxic").alias("toxic")).first()
    prior = prior if prior is not None else facts["toxic"] / facts["n"] if facts["n"] else 0.0
    if not facts["toxic"]:
        return PositiveUnlabelled([], prior)
    texts = docs.where(F.col("doc_id").isNotNull() & (doc_key(docs) % 3 != 1)).select("doc_id", text_of().alias("text"))
    toxic = texts.join(small(known.where("toxic").select("doc_id"), facts["toxic"]), "doc_id")
    sample = cut(sampled(toxic, toxic_rows).withColumn("toxic", F.lit(True)).unionByName(sampled(texts, unlabelled_rows).withColumn("toxic", F.lit(False))))

    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        counts = {True: Counter(), False: Counter()}

        def out():
            keys = list(counts[True].keys() | counts[False].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([counts[t][k] for k in keys], pa.int64()) for t in (True, False))], names=["feature", "a", "b"])
            counts[True].clear(), counts[False].clear()

        for batch in slices(batches):
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                counts[toxic].update({f for w in set(text.encode().translate(LETTERS).split()) for f in features_of(w)})
                if sum(map(len, counts.values())) > ENTRIES:
                    yield from out()
        yield from out()

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n, m = float(sizes.get(True, 0)), float(sizes.get(False, 0))
    counts = sample.mapInArrow(count, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = lambda k, n_k: F.when(k > 0, k * F.log(k * (n + m) / ((a + b) * n_k))).otherwise(0.0)
    counts = counts.where((a >= LEAST) & (a * m * prior >= PURE * b * n)).withColumn("g", F.round(2 * (ratio(a, n) + ratio(b, m)), 6))
    chosen = counts.where(F.col("g") >= SURE).orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").collect()
    model = PositiveUnlabelled([bytes(r["feature"]) for r in chosen], prior)

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo: dict = {}
        for batch in slices(batches):
            found = [model.found(t, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["h", "toxic", "x"])

    rows = sample.mapInArrow(read, "h long, toxic boolean, x array<int>").toPandas().sort_values(["toxic", "h"])
    x = np.zeros((len(rows), len(model.at)), dtype=np.uint8)
    for k, own in enumerate(rows["x"]):
        x[k, own] = 1
    is_toxic = rows["toxic"].to_numpy(dtype=bool)
    return model.fit(x[is_toxic], x[~is_toxic])


def score(docs: DataFrame, model: PositiveUnlabelled, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` with held_out, score and predicted."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memo: dict = {}
        for batch in slices(batches):
            s = model.score(batch.column("text").to_pylist(), memo)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = F.col("doc_id").isNotNull() & (doc_key(docs) % 3 == 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of the whole documents table, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
