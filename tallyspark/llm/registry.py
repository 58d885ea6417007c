"""The queries of this subpackage, one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
from tallyspark.llm import blocksearch, language, licences, lines, mixing, packing, rangejoin, runs, sharding, simhash, substrings, toxicity, whitening


def queries() -> dict:
    return {
        "op1_toxicity_counterfactual": toxicity.op1_toxicity_counterfactual,
        "op2_subset_sum_mixing": mixing.op2_subset_sum_mixing,
        "op3_language_backoff": language.op3_language_backoff,
        "op4_rendezvous_sharding": sharding.op4_rendezvous_sharding,
        "op5_simhash_golay": simhash.op5_simhash_golay,
        "op6_pivot_range_join": rangejoin.op6_pivot_range_join,
        "op7_block_max_search": blocksearch.op7_block_max_search,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_licence_dice": licences.op9_licence_dice,
        "op10_substring_doubling": substrings.op10_substring_doubling,
        "op11_first_lines": lines.op11_first_lines,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_bidiagonal_whitening": whitening.op13_bidiagonal_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_pivot_range_join": rangejoin.OP6_SQL, "op7_block_max_search": blocksearch.OP7_SQL, "op9_licence_dice": licences.oracle_sql(), "op10_substring_doubling": substrings.OP10_SQL, "op11_first_lines": lines.OP11_SQL}
