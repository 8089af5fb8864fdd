"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from candlespark.llm.chat_format import OP8_SQL, op8_chat_format
from candlespark.llm.divergence import OP13_SQL, op13_source_divergence
from candlespark.llm.embedding_dedup import op2_embedding_dedup
from candlespark.llm.fingerprints import op6_fingerprints
from candlespark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from candlespark.llm.line_dedup import op7_line_dedup
from candlespark.llm.mixing import OP5_SQL, op5_mixing
from candlespark.llm.ngram_join import op9_ngram_join
from candlespark.llm.packing import op1_packing
from candlespark.llm.quality import op3_quality
from candlespark.llm.secret_scan import op4_secret_scan
from candlespark.llm.token_counts import op10_token_counts
from candlespark.llm.toxicity import op12_toxicity


def queries() -> dict:
    """Query names to functions of (spark, sf_dir)."""
    return {
        "op1_packing": op1_packing,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_quality": op3_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_mixing": op5_mixing,
        "op6_fingerprints": op6_fingerprints,
        "op7_line_dedup": op7_line_dedup,
        "op8_chat_format": op8_chat_format,
        "op9_ngram_join": op9_ngram_join,
        "op10_token_counts": op10_token_counts,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_toxicity": op12_toxicity,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op5_mixing": OP5_SQL, "op8_chat_format": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
