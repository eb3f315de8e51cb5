"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, conversation_repair, embedding_dedup, exact_dedup, minhash_dedup, mixing, packing, quality, secrets, token_counts, toxicity, vector_codes, warc_zip


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_packing": packing.op2_packing,
        "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_warc_zip": warc_zip.op6_warc_zip,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_quality": quality.op9_quality,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_conversation_repair": conversation_repair.op11_conversation_repair,
        "op12_chat_format": chat_format.op12_chat_format,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_scan": secrets.ORACLE_SQL,
        "op3_minhash_dedup": minhash_dedup.ORACLE_SQL,
        "op4_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_warc_zip": warc_zip.ORACLE_SQL,
        "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op11_conversation_repair": conversation_repair.ORACLE_SQL,
        "op12_chat_format": chat_format.ORACLE_SQL,
        "op13_vector_codes": vector_codes.ORACLE_SQL,
    }
