"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, chat, langid, lengths, minhash, packing, secrets, suffix, topk, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.query,
        "op2_token_counts": lengths.query,
        "op3_suffix_array_dedup": suffix.query,
        "op4_byte_bpe": bytebpe.query,
        "op5_embedding_near_dedup": vectors.query,
        "op6_exact_top_k": topk.query,
        "op7_minhash_near_dedup": minhash.query,
        "op8_secret_scan": secrets.query,
        "op9_packing": packing.query,
        "op10_chat_format": chat.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_top_k": topk.ORACLE, "op10_chat_format": chat.ORACLE}
