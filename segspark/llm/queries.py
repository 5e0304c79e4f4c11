"""The ``opN_*`` queries and their DuckDB oracles."""

from __future__ import annotations

from . import embed_dedup, exact_dedup, hard_negatives, html_text, langid, license_scan, mixing, ngram_join, pieces, prefix_trie, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_sentencepiece": pieces.query,
    "op4_license_scan": license_scan.query,
    "op5_language_id": langid.query,
    "op6_warc": warc.query,
    "op7_mixing": mixing.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_embed_dedup": embed_dedup.query,
    "op10_exact_dedup": exact_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_html_text": html_text.query,
}

ORACLES = {
    "op1_ngram_join": ngram_join.ORACLE,
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op4_license_scan": license_scan.ORACLE,
    "op6_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_embed_dedup": embed_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_html_text": html_text.ORACLE,
}
