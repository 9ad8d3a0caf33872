"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, language_id, line_crf, line_dedup, media_columns, mixing, ngram_join, quality_rules, sharding, source_audit, substring_dedup, url_rules

QUERIES = {
    "op1_distribution_divergence": quality_rules.op1_distribution_divergence,
    "op2_byte_cnn": language_id.op2_byte_cnn,
    "op3_balanced_label_propagation": sharding.op3_balanced_label_propagation,
    "op4_site_relative_frequency": line_dedup.op4_site_relative_frequency,
    "op5_association_rules": url_rules.op5_association_rules,
    "op6_fm_index": substring_dedup.op6_fm_index,
    "op7_line_crf": line_crf.op7_line_crf,
    "op8_systematic_sampling": mixing.op8_systematic_sampling,
    "op9_signature_tree": ngram_join.op9_signature_tree,
    "op10_winnowing": decontaminate.op10_winnowing,
    "op11_source_divergence_audit": source_audit.op11_source_divergence_audit,
    "op12_media_columns": media_columns.op12_media_columns,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

ORACLE_SQL = {
    "op1_distribution_divergence": quality_rules.OP1_SQL,
    "op4_site_relative_frequency": line_dedup.OP4_SQL,
    "op6_fm_index": substring_dedup.OP6_SQL,
    "op8_systematic_sampling": mixing.OP8_SQL,
    "op9_signature_tree": ngram_join.OP9_SQL,
    "op10_winnowing": decontaminate.OP10_SQL,
    "op11_source_divergence_audit": source_audit.OP11_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
