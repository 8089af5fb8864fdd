import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from candlespark.llm import packing, token_counts, tokenize
from tests.llm.fixtures import empty, frame, texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenize.tokenizer_path())


ODD = ["a<|endoftext|>b. <|startoftext|>x", "<|ENDOFTEXT|> <|EndOfText|>", "it's, DON'T' '' ,,a.b.. A.", "É, ß. á. ́, x y, z\x1cq. \x85.", "İx ΣΑΣ. ǅa, ΌΔΟΣ, ª. ſ 12½ ７", "x" * 5000 + "!!", "日本語 テスト。 한국어 🎉🎉", "BELEDİYESİ. İ. SERİ, x TESTİ! İ", "H\u0331. h\u0331, AH\u0331a", ""]


def test_words_one_by_one_give_the_librarys_ids(library):
    for text in ODD + [t for _, t, _ in texts() if t][:20]:
        got = np.frombuffer(b"".join(next(tokenize.id_encoder(tokenize.tokenizer_path()).encode([text.encode()]))), dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_librarys_on_strings_of_letters_marks_and_combining_characters(library):
    rng = random.Random(5)
    letters = [chr(i) for i in range(0x370)] + list("İİıſKÅ'\"!.,-#<=>|0123456789 \n\tΣςßẞⅠ٣") + ["<|endoftext|>", "<|", "'s", "'LL", "İ.", "\u0338", "\u0307"]
    odd = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) for _ in range(20_000)]
    odd += ["".join(rng.choices("aHIİi\u0307\u0331\u0327Éé.,=<1 ", k=rng.randrange(1, 8))) for _ in range(20_000)]
    encoder = tokenize.id_encoder(tokenize.tokenizer_path())
    wrong = [t for t, words, want in zip(odd, encoder.encode(t.encode() for t in odd), library.encode_batch(odd, add_special_tokens=False)) if np.frombuffer(b"".join(words), dtype="<u4").tolist() != want.ids]
    assert not wrong


def test_memo_may_overflow(monkeypatch, library):
    monkeypatch.setattr(tokenize, "MEMO_WORDS", 10)
    e = tokenize.WordEncoder(tokenize.tokenizer_path(), len, sum)
    for text in [t for _, t, _ in texts() if t][:5]:
        assert sum(next(e.encode([text.encode()]))) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_and_cache(spark, tmp_path, library):
    docs, path = frame(spark), str(tmp_path / "cache")
    want = sorted((-1 if d is None else d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in texts())
    for _ in range(2):
        got = token_counts.token_counts(docs, path, limit=100).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got)
        n = spark.read.parquet(path).count()
        assert n == spark.read.parquet(path).select("digest").distinct().count()  # a second run encodes nothing
    assert token_counts.token_counts(empty(spark), str(tmp_path / "none")).count() == 0


def test_changed_vocabulary_is_another_version(spark, tmp_path, monkeypatch):
    docs, path = spark.createDataFrame([(1, "some words to count")], "doc_id long, text string"), str(tmp_path / "cache")
    whole = open(tokenize.tokenizer_path(), "rb").read()
    for n, raw in enumerate((whole, whole + b"\n", whole)):
        file = tmp_path / f"v{n}" / "word_bpe_49k.json"
        file.parent.mkdir()
        file.write_bytes(raw)
        monkeypatch.setattr(token_counts, "tokenizer_path", lambda name, file=file: str(file))
        assert token_counts.token_counts(docs, path).count() == 1
        assert spark.read.parquet(path).select("version").distinct().count() == min(n + 1, 2)
    with pytest.raises(ValueError):
        token_counts.token_counts(docs, path, tokenizer="byte_bpe_50k.json")


def test_packing(spark, library):
    rows = packing.pack(frame(spark), window=512, with_ids=True).collect()
    docs = {}
    for d, t, _ in texts():
        docs.setdefault(d, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.padded))
    for d, wanted in docs.items():
        if len(wanted) == 1:
            whole = [i for _, ids, _ in sorted(pieces[d]) for i in ids]
            assert whole == wanted[0] and all(n == len(whole) for _, _, n in pieces[d])
        else:
            assert sum(len(ids) for _, ids, _ in pieces[d]) == sum(map(len, wanted))
    used = 0
    for parts in windows.values():
        at = 0
        for offset, length, padded in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512 and padded == (at if at & (at - 1) == 0 else 512)
        used += padded
    assert sum(r.length for r in rows) / used > 0.95
    seqs = packing.sequences(packing.pack(frame(spark), window=512, with_ids=True)).collect()
    assert sum(len(s.ids) for s in seqs) == sum(r.length for r in rows)
    assert packing.pack(empty(spark)).count() == 0


def test_best_fit_finds_the_tightest_window():
    where, offset = packing.best_fit_decreasing([9, 8, 3, 2, 1, 1], 12)
    assert where == [0, 1, 0, 1, 1, 1] and offset == [0, 0, 9, 8, 10, 11]
    import random

    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 65) for _ in range(500)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if fits:
            room = min(fits)[0]
            i = next(i for i, r in enumerate(rooms) if r == room)
            rooms[i] -= n
        else:
            rooms.append(64 - n)
        want.append(len(rooms))
    where, _ = packing.best_fit_decreasing(lengths, 64)
    assert max(where) + 1 == len(rooms)
