"""The text operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import byte_bpe, divergence, exact_dedup, importance, license_scans, nnls_packing, packing, quality_rules, repeats, secret_scans, simhash, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_byte_bpe": byte_bpe.op2_byte_bpe,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_simhash": simhash.op4_simhash,
        "op5_secret_scans": secret_scans.op5_secret_scans,
        "op6_token_files": token_files.op6_token_files,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_importance_resampling": importance.op8_importance_resampling,
        "op9_repeated_passages": repeats.op9_repeated_passages,
        "op10_license_scans": license_scans.op10_license_scans,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_nnls_packing": nnls_packing.op12_nnls_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL, "op11_source_divergence": divergence.OP11_SQL}
