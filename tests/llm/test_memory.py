"""What the JVM and the Python workers of a task hold of texts at once."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from candlespark.llm import common
from candlespark.llm.line_dedup import op7_line_dedup

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    wide = spark.range(0, 9_000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))  # 18 MB
    return wide.mapInArrow(sizes, "n long").agg(F.max("n"), F.sum("n")).first()


@pytest.mark.parametrize("stage", [*(f for _, f in corpus_pipeline.STAGES), None])
def test_texts_come_to_python_in_small_batches(spark, tmp_path, stage):
    spark.createDataFrame([(1, "a text of a few words", "en", "s", 21)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.unset(NAME)
    try:
        if stage:
            stage(spark, common.table(spark, str(tmp_path), "documents"), str(tmp_path))
        else:
            op7_line_dedup(spark, str(tmp_path))
        most, total = largest(spark)
        assert most <= 1.2 * common.BATCH_BYTES < total
        spark.conf.set(NAME, "1000000")  # a session's own bound stays
        common.narrow_batches(spark)
        assert spark.conf.get(NAME) == "1000000"
    finally:
        spark.conf.unset(NAME)


def test_the_pipeline_packs_with_a_small_memo(spark, monkeypatch):
    from candlespark.llm import packing
    from candlespark.llm.tokenize import MEMO_WORDS, id_encoder, tokenizer_path

    asked = []
    monkeypatch.setattr(packing, "pack", lambda docs, **more: asked.append(more) or docs)
    corpus_pipeline.pack_sequences(spark, None, "")
    assert asked[0]["memo_words"] <= MEMO_WORDS // 3
    texts = [b"one two three, FOUR five", b"six seven", b"one two eight"]
    few, many = id_encoder(tokenizer_path(), 2), id_encoder(tokenizer_path())
    assert [list(few.encode([t])) for t in texts] == [list(many.encode([t])) for t in texts]
    assert len(few.memo) < len(many.memo)
