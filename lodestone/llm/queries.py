"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, license_scan, mixing, near_dedup, packing, suffix_dedup, token_output, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
        "op6_warc": warc.op6_warc,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_embedding_near_dedup": embedding_dedup.op8_embedding_near_dedup,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_token_output": token_output.op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": mixing.OP4_SQL,
        "op6_warc": warc.OP6_SQL,
        "op7_exact_dedup": exact_dedup.OP7_SQL,
        "op9_license_scan": license_scan.OP9_SQL,
    }
