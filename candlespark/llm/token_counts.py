"""Token counts through a digest cache.

The cache is a Parquet table of (digest, version, n_tokens): the digest is SHA-256 of the normalised content,
the version is a digest of the vocabulary file's bytes, so counts of several vocabularies live side by side. Documents
are joined to the cache; only the distinct missing contents are encoded, once each, and appended. Then the
documents, carried as digests without their texts, are joined to the cache again.

Texts aren't shuffled to find the distinct ones: digests are counted, and each content is encoded where its document
of smallest doc_id is read; which documents to leave out (those with a repeated content) is looked up, in a broadcast
table while that is small, else by a shuffled join. A content that comes without doc_id is encoded as often as it
comes, and so are rows equal in doc_id and content; the cache stores each once. In the last join contents that many
documents share are looked up in a bounded broadcast table.

Normalising collapses runs of ASCII white space to one blank and trims them, which the word-level tokenizer
does itself before it splits; so texts of equal digest have equal counts.

Defined cases: null text counts as empty (0 bytes, 0 tokens); null doc_id stays null; repeated rows each give
a row; an empty table gives no rows; a cache path that doesn't exist yet is an empty cache; repeated cache rows
(two runs that appended at once) are read as one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.llm.common import cut, scratch_path, slices, small, spread_join, table, text_of
from candlespark.llm.tokenize import count_encoder, tokenizer_path

LIMIT = 2048
#: Vocabulary files that the word-wise encoder is proven for.
WORD_WISE = ("word_bpe_49k.json",)
CACHE = "digest binary, version long, n_tokens long"


def version_of(path: str) -> int:
    """Signed 64-bit head of the SHA-256 of a vocabulary file's bytes."""
    with open(path, "rb") as f:
        return int.from_bytes(hashlib.file_digest(f, "sha256").digest()[:8], "little", signed=True)


def digest_of(text):
    """SHA-256 of the text after collapsing ASCII white space."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), 256))


def read_cache(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The stored counts of one tokenizer version, one row per digest; empty where nothing is stored yet."""
    try:
        found = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], CACHE)
    found = found.where(F.col("version") == version)
    return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_counts(texts: DataFrame, path: str, version: int) -> DataFrame:
    """``texts(digest, text)`` to cache rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = count_encoder(path)
        for batch in slices(batches):
            counts = [sum(x) for x in encoder.encode(t.encode() for t in batch.column("text").to_pylist())]
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([version] * n, pa.int64()), pa.array(counts, pa.int64())],
                names=["digest", "version", "n_tokens"],
            )

    return texts.select("digest", "text").mapInArrow(run, CACHE)


def token_counts(docs: DataFrame, cache_path: str, tokenizer: str = "word_bpe_49k.json", limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit; appends misses to the cache."""
    if tokenizer not in WORD_WISE:
        raise ValueError(f"no word-wise encoder is proven for {tokenizer}")
    spark = docs.sparkSession
    path = tokenizer_path(tokenizer)
    version = version_of(path)
    text = docs.select(F.col("doc_id"), text_of().alias("text")).withColumn("digest", digest_of(F.col("text")))
    light = cut(text.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))
    uses = cut(light.groupBy("digest").agg(F.count("*").alias("uses"), F.min("doc_id").alias("first")))
    known = read_cache(spark, cache_path, version)
    if known.isEmpty():  # a new cache: every content is a miss, and only repeated ones have rows to leave out
        chosen = text.join(small(uses.where("uses > 1").select("digest", "first")), "digest", "left").where("first IS NULL OR doc_id <=> first")
    else:
        missing = cut(uses.join(known.select("digest"), "digest", "left_anti").select("digest", "first"))
        chosen = text.join(small(missing), "digest").where("first IS NULL OR doc_id <=> first")
    encode_counts(chosen, path, version).groupBy("digest", "version").agg(F.min("n_tokens").alias("n_tokens")).write.mode("append").parquet(cache_path)
    facts = uses.select("digest", "uses").join(read_cache(spark, cache_path, version), "digest")
    return spread_join(light, facts, "digest", "uses").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of the whole documents table, through a cache that starts empty."""
    return token_counts(table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
