"""Registered queries of the llm operators and their DuckDB SQL."""

from __future__ import annotations

from . import benchmark_overlap, byte_bpe, centroid_clusters, fill_middle, id_files, licences, near_dedup, packing, pii, quality_crf, quality_rules, toxicity, vector_search

QUERIES = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_near_dedup": near_dedup.query,
    "op3_vector_search": vector_search.query,
    "op4_id_files": id_files.query,
    "op5_quality_rules": quality_rules.query,
    "op6_quality_crf": quality_crf.query,
    "op7_pii": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_licences": licences.query,
    "op10_packing": packing.query,
    "op11_centroid_clusters": centroid_clusters.query,
    "op12_fill_middle": fill_middle.query,
    "op13_decontamination": benchmark_overlap.query,
}

ORACLES = {
    "op2_near_dedup": near_dedup.oracle,
    "op3_vector_search": vector_search.oracle,
    "op5_quality_rules": quality_rules.oracle,
    "op9_licences": licences.oracle,
    "op11_centroid_clusters": centroid_clusters.oracle,
    "op12_fill_middle": fill_middle.oracle,
    "op13_decontamination": benchmark_overlap.oracle,
}
