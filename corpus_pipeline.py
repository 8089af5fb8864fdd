"""The corpus pipeline: quality filter, line dedup, near-document dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame; all but
the last return the columns of documents. ``run`` writes each stage's rows as Parquet in the shared folder and
reads them again, so a lost executor costs at most one stage. Stages bound the session's Arrow batches (``narrow_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candlespark.llm import line_dedup, mixing, ngram_join, packing, quality
from candlespark.llm.common import narrow_batches, scratch_path, table

#: Words that a Python worker remembers when it packs; workers keep them through the stages that follow in a session.
MEMO_WORDS = 200_000


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the quality classifier doesn't reject; learnt from the labels of documents in ``docs``."""
    narrow_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, quality.THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; those of which nothing is left are gone."""
    narrow_batches(spark)
    return line_dedup.without_repeats(docs)


def near_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    narrow_batches(spark)
    return ngram_join.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    narrow_batches(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    narrow_batches(spark)
    return packing.pack(docs, memo_words=MEMO_WORDS)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", near_documents),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the fitted classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return STAGES[-1][1](spark, rows, sf_dir)
