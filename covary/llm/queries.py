"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from covary.llm import bpe, centroids, decontaminate, divergence, html_text, language, line_dedup, mpeg_audio, pii, sharding, simhash, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_simhash_near_dedup": simhash.query,
    "op3_decontaminate": decontaminate.query,
    "op4_language_id": language.query,
    "op5_byte_bpe": bpe.query,
    "op6_toxicity": toxicity.query,
    "op7_line_dedup": line_dedup.query,
    "op8_mpeg_audio": mpeg_audio.query,
    "op9_extendible_sharding": sharding.query,
    "op10_html_text": html_text.query,
    "op11_ns_clustering": centroids.query,
    "op12_pii": pii.query,
    "op13_source_divergence": divergence.query,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op9_extendible_sharding": sharding.SQL,
    "op11_ns_clustering": centroids.SQL,
    "op12_pii": pii.SQL,
    "op13_source_divergence": divergence.SQL,
}
