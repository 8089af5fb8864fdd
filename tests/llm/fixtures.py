"""Documents with nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size long, target double, key long, sig long, dk long, gone string, "
    "block long, extra boolean, line long, position double, copies long, score double, label long"
)


def words(rng, n):
    return " ".join(rng.choice(["ab", "Cde", "fghi,", "the", "of", "x1", "jklm.", "élan", "no"]) + str(rng.randrange(900)) for _ in range(n))


def texts(seed=1):
    """(doc_id, text, source) with copies, near copies, shared lines and odd texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        rows.append([i, "\n".join(words(rng, 60) for _ in range(3)), f"s{i % 4}"])
    for i in range(40, 52):  # near copies of one text, edited more and more
        w = rows[0][1].split(" ")
        for _ in range(i - 40):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        rows.append([i, " ".join(w), "s0"])
    for i in range(52, 58):  # exact copies
        rows.append([i, rows[5][1], "s1"])
    shared = words(rng, 55)
    for i in range(10, 16):
        rows[i][1] += "\n" + shared
    rows += [[58, None, "s2"], [59, "", "s2"], [60, " \n\t ", None], [61, "one two", "s3"], [62, "ONE  two", "s3"], [None, words(rng, 30), None], [64, words(rng, 30_000), "s1"], [65, "a" * 50_000, "s1"], [66, "end<|endoftext|> of. it's", ""], [67, "ümlaut ß ñandú İstanbul", "s1"]]
    rows += [list(rows[7]), list(rows[7]), [7, "another text of the same id with words enough", "s3"]]
    return [tuple(r) for r in rows]


def frame(spark, rows=None):
    """The rows as documents with clashing extra columns."""
    filled = [(d, t, "en", s, len(t or ""), 1, 1.0, 2, 3, 4, "x", 5, True, 6, 0.5, 7, 0.1, 1) for d, t, s in (texts() if rows is None else rows)]
    return spark.createDataFrame(filled, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
