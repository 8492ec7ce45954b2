"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import chat, decontaminate, embeddings, language, pieces, pseudo, quality, secrets, simhash, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embeddings.op1_embedding_dedup,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_lm_score": pseudo.op3_lm_score,
        "op4_chat_format": chat.op4_chat_format,
        "op5_language": language.op5_language,
        "op6_quality": quality.op6_quality,
        "op7_warc": warc.op7_warc,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_simhash_dedup": simhash.op10_simhash_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """The others learn a model, search within bits or run a tokenizer; tests compare them with brute force."""
    return {
        "op1_embedding_dedup": embeddings.OP1_SQL,
        "op4_chat_format": chat.OP4_SQL,
        "op7_warc": warc.OP7_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
    }
