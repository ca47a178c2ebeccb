"""Registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from textloom.llm import attention_lm, hard_negatives, language_id, line_dedup, matroska, mixing, ngram_join, packing, sharding, suffix_dedup, target_encoding, vector_search, warc


def queries() -> dict:
    return {
        "op1_attention_lm": attention_lm.op1_attention_lm,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_vector_search": vector_search.op3_vector_search,
        "op4_matroska": matroska.op4_matroska,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_packing": packing.op6_packing,
        "op7_language_id": language_id.op7_language_id,
        "op8_sharding": sharding.op8_sharding,
        "op9_mixing": mixing.op9_mixing,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_warc": warc.op11_warc,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_target_encoding": target_encoding.op13_target_encoding,
    }


def oracle_sql() -> dict:
    return {"op2_ngram_join": ngram_join.oracle_sql(), "op9_mixing": mixing.oracle_sql(), "op10_line_dedup": line_dedup.oracle_sql(), "op11_warc": warc.oracle_sql(), "op12_hard_negatives": hard_negatives.oracle_sql(), "op13_target_encoding": target_encoding.oracle_sql()}
