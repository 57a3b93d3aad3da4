"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from . import decontaminate, mixing, near_dedup, quality, secrets, substring_dedup, suffix_dedup, suffix_tree_lm, topk_search, toxicity

QUERIES = {
    "op2_norm_bucketed_topk": topk_search.query,
    "op6_latent_decontamination": decontaminate.query,
    "op9_suffix_tree_lm": suffix_tree_lm.query,
    "op1_additive_quality": quality.query,
    "op7_noisy_or_toxicity": toxicity.query,
    "op8_novelty_secrets": secrets.query,
    "op5_hyperminhash_dedup": near_dedup.query,
    "op3_pivotal_mixing": mixing.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op10_relative_lempel_ziv": substring_dedup.query,
}
ORACLES: dict[str, str] = {"op2_norm_bucketed_topk": topk_search.ORACLE}
