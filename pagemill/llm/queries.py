"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pagemill.llm import chosen_path, chunk_recipes, decontaminate, hilbert_shards, line_crf, mixing, periodic_runs, source_divergence, substring_dedup, token_counts, toxicity, url_filter, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_warc": warc.op2_warc,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_chosen_path": chosen_path.op5_chosen_path,
    "op6_hilbert_shards": hilbert_shards.op6_hilbert_shards,
    "op7_mixing": mixing.op7_mixing,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_crf": line_crf.op10_line_crf,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_source_divergence": source_divergence.op12_source_divergence,
    "op13_chunk_recipes": chunk_recipes.op13_chunk_recipes,
}
ORACLE_SQL = {
    "op2_warc": warc.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_url_filter": url_filter.SQL,
    "op5_chosen_path": chosen_path.SQL,
    "op8_decontamination": decontaminate.SQL,
    "op11_periodic_runs": periodic_runs.SQL,
    "op12_source_divergence": source_divergence.SQL,
    "op13_chunk_recipes": chunk_recipes.SQL,
}
