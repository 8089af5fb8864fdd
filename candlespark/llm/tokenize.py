"""Public tokenizers inside Spark tasks: whole texts to ids or counts, with a memo over words.

The vocabulary file word_bpe_49k.json (library ``tokenizers``) has a normaliser and a pre-tokenizer that never
join characters across ASCII white space, so a text's ids are its words' ids one after another. A task splits
texts at ASCII white space and asks the library only for words that it has not met yet.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

#: Words kept per task process; the memo is emptied when it is full, which costs time but changes no result.
MEMO_WORDS = 700_000
#: ASCII marks that may end a word and be encoded apart (the apostrophe is left out, as it can start a contraction).
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def folded(text: bytes) -> bytes:
    """``text`` with A-Z in lower case, so that fewer words are distinct, where that can't change its ids: it holds no
    special token, and is in normal form before and after, as the normaliser composes before it lowers (an H with a
    macron below stays two characters, an h with one becomes one)."""
    if b"<|" in text:
        return text
    low = text.lower()
    if low is text or text.isascii():
        return low
    whole = unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", low.decode())
    return low if whole else text


class WordEncoder:
    """Maps words (bytes without ASCII white space) to ``pack(ids)`` through a bounded memo; ``join`` adds up
    the packed values of a word's two parts. All ids come from the library."""

    def __init__(self, path: str, pack: Callable, join: Callable, most: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self._tok, self._pack, self._join, self._most, self.memo = Tokenizer.from_file(path), pack, join, most, {}

    @staticmethod
    def cut(word: bytes) -> int:
        """Where a trailing run of marks begins that can be encoded apart, or 0: only after an ASCII digit or a letter
        below U+0250 that is still one letter in lower case, and not in words that may hold a special token. Between
        such a character and ASCII marks the pre-tokenizer always cuts, and nothing composes across."""
        stem = word.rstrip(MARKS)
        if len(stem) == len(word) or not stem or b"<|" in word:
            return 0
        last = stem[-1:] if stem[-1] < 128 else stem[-2:]
        if len(last) == 2 and not 0xC3 <= last[0] <= 0xC8 or last == "\u0130".encode():
            return 0
        return len(stem) if last.isdigit() or last.decode("utf-8", "replace").isalpha() else 0

    def learn(self, words: Iterable[bytes]) -> None:
        """Puts words into the memo, each distinct part through the library once."""
        memo = self.memo
        asked = [w for w in words if w not in memo]
        cuts = [self.cut(w) for w in asked]
        parts = {p for w, c in zip(asked, cuts) for p in ((w[:c], w[c:]) if c else (w,))}
        parts = [p for p in parts if p not in memo]
        for part, found in zip(parts, self._tok.encode_batch_fast([p.decode("utf-8") for p in parts], add_special_tokens=False)):
            memo[part] = self._pack(found.ids)
        for w, c in zip(asked, cuts):
            if c:
                memo[w] = self._join((memo[w[:c]], memo[w[c:]]))

    def encode(self, texts: Iterable[bytes]) -> Iterator[list]:
        """For each text the packed values of its words, in order."""
        memo = self.memo
        for text in texts:
            words = folded(text).split()
            try:
                yield list(map(memo.__getitem__, words))
                continue
            except KeyError:
                pass
            out = []
            for at in range(0, len(words), 50_000):
                if len(memo) > self._most:
                    memo.clear()
                part = words[at : at + 50_000]
                self.learn(set(part))
                out += map(memo.__getitem__, part)
            yield out


@lru_cache(maxsize=2)
def id_encoder(path: str, most: int = MEMO_WORDS) -> WordEncoder:
    """Words to their ids as little-endian unsigned 32-bit bytes; one encoder serves all tasks of a process."""
    import struct

    return WordEncoder(path, lambda ids: struct.pack(f"<{len(ids)}I", *ids), b"".join, most)


@lru_cache(maxsize=2)
def count_encoder(path: str) -> WordEncoder:
    """Words to their number of ids."""
    return WordEncoder(path, len, sum)
