"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch of documents.

Words are runs of anything but ASCII white space, in texts with A-Z lower-cased. A word's hash is a polynomial
over random per-byte values, taken from one running sum over all bytes of the batch; a shingle's hash combines
those of its words. Hashes are fixed by the constants below, so they are equal in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text hashed at once; a longer document is a batch of its own.
CHUNK = 1_000_000
_tables: dict = {}


def mix(x):
    """A fixed bijection of 64-bit integers that spreads every bit over all others."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int):
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    import numpy as np

    found = _tables.get(base)
    if found is None or len(found) < n:
        found = np.ones(1, dtype=np.uint64)
        while len(found) < n:
            found = np.concatenate([found, found * np.uint64(pow(base, len(found), 1 << 64))])
        _tables[base] = found
    return found[:n]


def word_hashes(texts: list[bytes]):
    """Hashes of all words of ``texts`` in order, and the number of words per text."""
    import numpy as np

    if "byte" not in _tables:
        white = np.zeros(256, dtype=bool)
        white[[32, *range(9, 14)]] = True
        _tables["white"] = white
        _tables["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))
        _tables["inverse"] = pow(BASE, -1, 1 << 64)
    raw = np.frombuffer(b"\n" + b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    white = _tables["white"][raw]
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_tables["byte"][raw] * powers(BASE, len(raw)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(_tables["inverse"], len(raw))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(starts, bounds, side="right"), prepend=0)
    return hashes, per_text


def shingle_sets(texts: list[bytes], size: int) -> Iterator:
    """For each text the sorted distinct hashes of its shingles of ``size`` words; a shorter text that has words
    is one shingle as a whole; a text without words has none."""
    import numpy as np

    at = 0
    while at < len(texts):
        upto, length = at + 1, len(texts[at])
        while upto < len(texts) and length + len(texts[upto]) <= CHUNK:
            length += len(texts[upto])
            upto += 1
        words, counts = word_hashes(texts[at:upto])
        weight = [np.uint64(pow(STEP, k + 1, 1 << 64)) for k in range(size)]
        padded = np.concatenate([words, np.zeros(size, dtype=np.uint64)])
        all_of = mix(sum(padded[k : len(padded) - size + k] * weight[k] for k in range(size)))
        first = 0
        for n in counts.tolist():
            if n >= size:
                yield np.unique(all_of[first : first + n - size + 1])
            elif n:
                yield mix(np.array([sum(int(words[first + k]) * int(weight[k]) for k in range(n)) + n & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) ^ np.uint64(BASE))
            else:
                yield np.zeros(0, dtype=np.uint64)
            first += n
        at = upto


def set_signature(hashes) -> int:
    """A signed 64-bit signature of a set of hashes."""
    import numpy as np

    total = int(np.add.reduce(mix(hashes ^ np.uint64(STEP)))) if len(hashes) else 0
    total = (total ^ (len(hashes) * BASE)) & 0xFFFFFFFFFFFFFFFF
    return total - (1 << 64) if total >= 1 << 63 else total
