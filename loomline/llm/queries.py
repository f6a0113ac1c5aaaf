"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from loomline.llm import bpe, byte_bpe, collocations, divergence, exact_dedup, html_text, mixing, prefix_trees, pu_quality, quality_rules, simhash, suffix_levels, token_counts

QUERIES = {
    "op1_bpe_automaton": bpe.op1_bpe_automaton,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pu_quality": pu_quality.op4_pu_quality,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_prefix_trees": prefix_trees.op7_prefix_trees,
    "op8_html_text": html_text.op8_html_text,
    "op9_block_naming": exact_dedup.op9_block_naming,
    "op10_suffix_levels": suffix_levels.op10_suffix_levels,
    "op11_collocations": collocations.op11_collocations,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

SQL = {
    "op3_quality_rules": quality_rules.OP3_SQL,
    "op7_prefix_trees": prefix_trees.OP7_SQL,
    "op9_block_naming": exact_dedup.OP9_SQL,
    "op10_suffix_levels": suffix_levels.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
