"""The queries of this subpackage, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from palimpsest.llm import alignment, chat, languages, laws, licenses, minhash, mixing, packing, periods, quality, repeats, sharding, topk, toxicity

QUERIES = {
    "op1_chat_formatting": chat.op1,
    "op2_sharding": sharding.op2,
    "op3_minhash_near_dedup": minhash.op3,
    "op4_best_fit_packing": packing.op4,
    "op5_toxicity": toxicity.op5,
    "op6_suffix_array_dedup": repeats.op6,
    "op7_quality_rules": quality.op7,
    "op8_mixing": mixing.op8,
    "op9_license_scan": licenses.op9,
    "op10_exact_top_k": topk.op10,
    "op11_token_alignment": alignment.op11,
    "op12_language_id": languages.op12,
    "op13_periodic_runs": periods.op13,
    "quality_counts": laws.quality_counts,
    "mix_targets": laws.mix_targets,
    "shard_law": laws.shard_law,
    "packing_law": laws.packing_law,
    "toxicity_rows": laws.toxicity_rows,
    "repeat_rows": laws.repeat_rows,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force, and SQL says what they must obey.
ORACLES = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op10_exact_top_k": topk.OP10_SQL,
    "quality_counts": laws.QUALITY_COUNTS_SQL,
    "mix_targets": laws.MIX_TARGETS_SQL,
    "shard_law": laws.SHARD_LAW_SQL,
    "packing_law": laws.PACKING_LAW_SQL,
    "toxicity_rows": laws.TOXICITY_ROWS_SQL,
    "repeat_rows": laws.REPEAT_ROWS_SQL,
}
