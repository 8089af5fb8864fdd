"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of counted features. Shallow trees, boosted in turn over the features, add up to one
lookup table per feature; the strongest pairs of features then get two-dimensional tables in the same way. A
score is the logistic of the sum of table entries, so scoring is binning and vectorised additions.

The features of every document are counted on the executors. Only those of a bounded, hash-chosen sample of
labelled rows (``train_rows``) come to the driver, where the tables are fitted; the fitted tables are a few
ten kilobytes and travel with the scoring tasks.

Defined cases: null text scores as the empty text; several labels of one doc_id count as their mean; null
labels and labels of unknown documents are ignored; without any labelled row every score is 0.5 and with labels
of one kind only every score is near that label; null doc_id is never held out and never trained on; repeated
rows each get a score and teach once (of several texts of one doc_id, the one whose features come first); an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import doc_key, slices, small, table, text_of

THRESHOLD = 0.7
#: Most labelled rows that the tables are fitted on.
TRAIN_ROWS = 20_000
NAMES = (
    "words", "word_length", "distinct_words", "distinct_pairs", "top_word", "short_words", "long_words", "upper_letters",
    "upper_words", "digits", "marks", "odd_marks", "shouts", "bars", "stops", "commas", "lines", "distinct_lines",
    "line_length", "repeated_in_lines", "beyond_ascii", "control",
)


def features(texts: list[str]):
    """Matrix of the features of whole texts, a row each, in the order of NAMES."""
    import numpy as np

    kind = np.zeros((256, 8))  # upper, lower, digit, mark, odd mark, beyond ASCII, control, white space
    for b in range(256):
        c = chr(b)
        white = b == 32 or 9 <= b <= 13
        flags = (65 <= b <= 90, 97 <= b <= 122, 48 <= b <= 57, 32 < b < 127 and not c.isalnum(), c in "#$%&*+/<=>@[\\]^_`{|}~", b >= 128, b < 32 and not white or b == 127, white)
        kind[b] = flags
    out = np.zeros((len(texts), len(NAMES)))
    for row, text in enumerate(texts):
        raw = text.encode()
        if not raw:
            continue
        count = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        upper, lower, digit, mark, odd, beyond, control, white = count @ kind
        size, letters = len(raw), max(upper + lower, 1)
        words = raw.split()
        n = max(len(words), 1)
        uses: dict[bytes, int] = {}
        for w in words:
            uses[w] = uses.get(w, 0) + 1
        lines = [x for x in raw.split(b"\n") if x.strip()]
        m = max(len(lines), 1)
        lengths = np.fromiter(map(len, uses), dtype=np.int64, count=len(uses))
        times = np.fromiter(uses.values(), dtype=np.int64, count=len(uses))
        kept = set(lines)
        pairs = len(set(zip(words, words[1:])))
        out[row] = (
            np.log1p(len(words)), (size - white) / n, len(uses) / n, (pairs + 1) / n, times.max(initial=0) / n,
            times[lengths <= 3].sum() / n, times[lengths >= 20].sum() / n, upper / letters, raw.isupper(), digit / size,
            mark / size, odd / size, count[33] / n, count[124] / n, count[46] / n, count[44] / n, np.log1p(len(lines)),
            len(kept) / m, size / m, sum(map(len, kept)) / max(sum(map(len, lines)), 1), beyond / size, control / size,
        )
    return out


def grow(gain_g, gain_h, leaves: int, rate: float, smooth: float):
    """A shallow tree over ordered bins: at most ``leaves`` runs of bins, split greedily; values per bin."""
    import numpy as np

    sum_g, sum_h = np.concatenate([[0.0], np.cumsum(gain_g)]), np.concatenate([[0.0], np.cumsum(gain_h)])
    cuts = [0, len(gain_g)]
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            k = np.arange(a + 1, b)
            left, right = (sum_g[k] - sum_g[a], sum_h[k] - sum_h[a]), (sum_g[b] - sum_g[k], sum_h[b] - sum_h[k])
            whole = (sum_g[b] - sum_g[a]) ** 2 / (sum_h[b] - sum_h[a] + smooth)
            gain = left[0] ** 2 / (left[1] + smooth) + right[0] ** 2 / (right[1] + smooth) - whole
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], a + 1 + at)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    value = np.zeros(len(gain_g))
    for a, b in zip(cuts, cuts[1:]):
        value[a:b] = rate * (sum_g[b] - sum_g[a]) / (sum_h[b] - sum_h[a] + smooth)
    return value


def quadrants(g, h, smooth: float):
    """The best cut of a grid of sums into four quadrants: its gain, row cut, column cut and leaf values."""
    import numpy as np

    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))

    def parts(c):
        i, j = c[1:-1, 1:-1], c[-1, -1]
        return i, c[1:-1, -1:] - i, c[-1:, 1:-1] - i, j - c[1:-1, -1:] - c[-1:, 1:-1] + i

    gs, hs = parts(cg), parts(ch)
    gain = sum(a * a / (b + smooth) for a, b in zip(gs, hs)) - cg[-1, -1] ** 2 / (ch[-1, -1] + smooth)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    return gain[at], at[0] + 1, at[1] + 1, [a[at] / (b[at] + smooth) for a, b in zip(gs, hs)]


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 48, grid: int = 12, rounds: int = 60, pair_rounds: int = 25, pairs: int = 6, rate: float = 0.15, leaves: int = 4, smooth: float = 5.0):
        self.bins, self.grid, self.rounds, self.pair_rounds, self.n_pairs = bins, grid, rounds, pair_rounds, pairs
        self.rate, self.leaves, self.smooth, self.base, self.edges, self.tables, self.pairs = rate, leaves, smooth, 0.0, [], [], []

    def fit(self, x, y):
        """Fits the tables to features ``x`` and labels ``y`` in 0..1."""
        import numpy as np

        if not len(y):
            return self
        mean = np.clip(y.mean(), 0.001, 0.999)
        self.base = float(np.log(mean / (1 - mean)))
        cuts = lambda v, n: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1]))
        self.edges = [cuts(v, self.bins) for v in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        at = [np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T)]
        score = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-score))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(self.rounds):
            for j, table in enumerate(self.tables):
                g, h = slopes()
                step = grow(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), self.leaves, self.rate, self.smooth)
                table += step
                score += step[at[j]]
        wide = [cuts(v, self.grid) for v in x.T]
        coarse = [np.searchsorted(e, v, side="right") for e, v in zip(wide, x.T)]
        sums = lambda i, j, v: np.bincount(coarse[i] * (len(wide[j]) + 1) + coarse[j], v, (len(wide[i]) + 1) * (len(wide[j]) + 1)).reshape(len(wide[i]) + 1, -1)
        g, h = slopes()
        usable = [j for j, e in enumerate(wide) if len(e)]
        gains = sorted(((quadrants(sums(i, j, g), sums(i, j, h), self.smooth)[0], i, j) for n, i in enumerate(usable) for j in usable[n + 1 :]), reverse=True)
        self.pairs = [(i, j, wide[i], wide[j], np.zeros((len(wide[i]) + 1, len(wide[j]) + 1))) for _, i, j in gains[: self.n_pairs]]
        for _ in range(self.pair_rounds):
            for i, j, _, _, table in self.pairs:
                g, h = slopes()
                _, r, c, leaf = quadrants(sums(i, j, g), sums(i, j, h), self.smooth)
                step = np.zeros_like(table)
                step[:r, :c], step[:r, c:], step[r:, :c], step[r:, c:] = (self.rate * v for v in leaf)
                table += step
                score += step[coarse[i], coarse[j]]
        return self

    def score(self, x):
        """Scores in 0..1 for features ``x``."""
        import numpy as np

        total = np.full(len(x), self.base)
        for v, edges, table in zip(x.T, self.edges, self.tables):
            total += table[np.searchsorted(edges, v, side="right")]
        for i, j, a, b, table in self.pairs:
            total += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits the model on at most about ``train_rows`` labelled documents, chosen by a hash of doc_id."""
    import numpy as np

    wanted = labels.where(F.col(column).isNotNull() & (doc_key(labels) % 4 != 2) & F.col("doc_id").isNotNull())
    wanted = wanted.groupBy("doc_id").agg(F.avg(F.col(column).cast("double")).alias("label"))
    n = wanted.count()
    if n > train_rows:
        wanted = wanted.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * train_rows / n))
        n = train_rows
    sample = docs.select("doc_id", text_of().alias("text")).join(small(wanted, n), "doc_id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    rows = sample.select(F.col("doc_id").cast("long"), "label", "text").mapInArrow(run, "doc_id long, label double, x array<double>")
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).toPandas()  # one row an id, however often it comes
    rows = rows.assign(first=[tuple(v) for v in rows["x"]]).sort_values(["doc_id", "first"])
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(NAMES)))
    return AdditiveModel().fit(x, rows["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs(doc_id, text)`` with held_out, score and predicted."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            s = model.score(features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), (F.col("doc_id").isNotNull() & (doc_key(docs) % 4 == 2)).alias("held_out"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: AdditiveModel, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``."""
    own = docs.columns
    text = own.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            yield batch.filter(pa.array(model.score(features(texts)) >= threshold, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*own)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of the whole documents table, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
