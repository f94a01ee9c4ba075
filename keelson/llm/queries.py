"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import filter_audit, funnels, licenses, mixing, mixing_model, packed, packing, pieces, quality, simhash, suffixes, toxicity, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_lm_scoring": mixing_model.op2_lm_scoring,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_source_mixing": mixing.op5_source_mixing,
        "op6_suffix_array_dedup": suffixes.op6_suffix_array_dedup,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_token_binary": packed.op8_token_binary,
        "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op11_packing": packing.op11_packing,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_ordered_funnels": funnels.op13_ordered_funnels,
        "license_base_places": licenses.license_base_places,
        "lm_base_scores": mixing_model.lm_base_scores,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.OP3_SQL,
        "op6_suffix_array_dedup": suffixes.OP6_SQL,
        "op10_embedding_near_dedup": vectors.OP10_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_ordered_funnels": funnels.OP13_SQL,
        "license_base_places": licenses.BASE_SQL,
        "lm_base_scores": mixing_model.BASE_SQL,
    }
