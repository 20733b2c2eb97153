"""The registered queries of this subpackage."""

from __future__ import annotations

from moraine.llm import imatch, language, mixing, packing, periodic, ppm, quality, quantized, sharding, token_counts, token_groups, url_filter, yinyang


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            language.op1_byte_recurrent_language,
            packing.op2_sum_of_squares_packing,
            quality.op3_quadratic_quality,
            sharding.op4_prefix_shards,
            mixing.op5_hypergeometric_mix,
            token_groups.op6_token_group_join,
            ppm.op7_partial_matching,
            quantized.op8_quantized_tiles,
            imatch.op9_imatch_fingerprints,
            url_filter.op10_url_reputation,
            yinyang.op11_yinyang_grouping,
            token_counts.op12_whole_token_shortcut,
            periodic.op13_block_matching_runs,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_url_reputation": url_filter.SQL, "op11_yinyang_grouping": yinyang.SQL}
