"""Sequence packing by best-fit decreasing.

Every document becomes ids plus an end mark. Overlong documents are first cut into full windows; what is left
of every document (shorter than a window) is packed by best-fit decreasing: pieces in falling length, each
put into the open window with the least room that still holds it, found in a segment tree over remaining
capacities. Tokenising, cutting and checksums happen in one pass over the texts, whose small piece rows are kept in
the shared folder. Full windows are sequences as they are and go nowhere; only what is left of a document, at most one
piece each, is shuffled and packed, per shard of about ``SHARD_ROWS`` pieces, whose number follows the table's rows.

Which shard a piece goes to hangs on its place in its file split, so that repeated rows spread too; another layout of
the files gives other sequences, as full as these.

Defined cases: null text packs as empty (one end mark); a null doc_id stays null; repeated rows are packed
once per row; an empty table gives no rows; further input columns are ignored, so clashing names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import cut, slices, text_of
from candlespark.llm.tokenize import MEMO_WORDS, id_encoder, tokenizer_path

WINDOW = 4096
END_ID = 2
#: Rows of documents that one shard packs, about; a shard leaves a handful of windows open at its end.
SHARD_ROWS = 20_000
#: Sequence ids of full windows begin here; shards number theirs below.
FULL = 1 << 62

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, ids binary"


def pieces(docs: DataFrame, shards: int, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece: whole windows of overlong documents, then the rest of each document."""

    def divide(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, end = id_encoder(path, memo_words), end_id.to_bytes(4, "little")
        row = 0
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "shard", "ids")}
            ids_of = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for doc_id, words in zip(ids_of, encoder.encode(t.encode() for t in texts)):
                words.append(end)
                ids = b"".join(words)
                total = len(ids) // 4
                row += 1
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(total)
                    out["shard"].append(zlib.crc32(b"%d %d" % (row, doc_id or 0)) % shards)
                    out["ids"].append(part if with_ids else None)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in PIECE.split(", "))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(divide, PIECE)


class RoomTree:
    """Segment tree over remaining capacities 0..size: per capacity the number of open windows with that room."""

    def __init__(self, size: int):
        self.leaves = 1
        while self.leaves <= size:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int:
        """The least room >= need among open windows, or -1."""
        at = need + self.leaves
        count = self.count
        if count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return -1


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """For lengths in falling order, the window index and offset of each."""
    tree, open_by_room, used = RoomTree(window), {}, 0
    where, offset = [], []
    for length in lengths:
        room = tree.tightest(length)
        if room < 0:
            at, room = used, window
            used += 1
        else:
            tree.add(room, -1)
            at = open_by_room[room].pop()
        where.append(at)
        offset.append(window - room)
        if room > length:
            tree.add(room - length, 1)
            open_by_room.setdefault(room - length, []).append(at)
    return where, offset


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, shard_rows: int = SHARD_ROWS, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into windows.

    Returns per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded (the window's
    length after padding: the window, or the filled length where that is a power of two), and ids where asked.
    """
    path = path or tokenizer_path()
    shards = max(1, -(-docs.count() // shard_rows))
    found = cut(pieces(docs, shards, path, window, end_id, with_ids, memo_words))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded", *["ids"] * with_ids]
    kinds = ["long"] * 7 + ["int", *["binary"] * with_ids]

    def place(key, pdf):
        import numpy as np

        pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
        where, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        filled = np.bincount(where, weights=pdf["length"].to_numpy()).astype(np.int64)
        filled = np.where(filled & (filled - 1) == 0, filled, window)
        pdf["sequence_id"] = np.asarray(where, dtype=np.int64) + (int(key[0]) << 32)  # below FULL
        pdf["offset"] = np.asarray(offset, dtype=np.int64)
        pdf["padded"] = filled[where].astype(np.int32)
        return pdf[names]

    schema = ", ".join(map(" ".join, zip(names, kinds)))
    full = found.where(F.col("length") == window).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(FULL))
    full = full.withColumn("offset", F.lit(0).cast("long")).withColumn("padded", F.lit(window))
    rest = found.where(F.col("length") < window).groupBy("shard").applyInPandas(place, schema)
    return rest.unionByName(full.select(names))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed windows themselves, from ``pack(with_ids=True)``: sequence_id, ids (array of int), padded."""

    def build(key, pdf):
        import numpy as np
        import pandas as pd

        ids = np.frombuffer(b"".join(pdf.sort_values("offset")["ids"]), dtype="<u4").astype(np.int32)
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [ids], "padded": [int(pdf["padded"].iloc[0])]})

    return packed.groupBy("sequence_id").applyInPandas(build, "sequence_id long, ids array<int>, padded int")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document of the table, packed into windows of 4096."""
    from candlespark.llm.common import table

    return pack(table(spark, sf_dir, "documents")).drop("padded")
