"""The queries of this subpackage, by their registered names, and the SQL of those that SQL can express."""

from __future__ import annotations

from pagewright.llm import decontaminate, html_text, line_dedup, quality, sentencepiece_codec, sharding, simhash, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_html_extraction": html_text.op5_html_extraction,
        "op6_sharding": sharding.op6_sharding,
        "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
        "quality_ablations": quality.quality_ablations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality.OP4_SQL, "op9_url_filter": url_filter.OP9_SQL, "quality_ablations": quality.QUALITY_ABLATIONS_SQL}
