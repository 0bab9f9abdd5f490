"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from auditloom.llm import bpe, exact_dedup, gru_lm, jaccard_join, packing, pii, quality, sharding, toxicity, warc


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_sharding": sharding.op2_sharding,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_packing": packing.op5_packing,
        "op6_gru_lm": gru_lm.op6_gru_lm,
        "op7_pii": pii.op7_pii,
        "op8_bpe": bpe.op8_bpe,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard_join": jaccard_join.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op9_quality_rules": quality.ORACLE, "op10_warc": warc.ORACLE}
