"""Registry of the corpus queries and of the SQL that must give the same rows."""

from __future__ import annotations

from tarnflow.llm import alignment, bpe_tree, divergence, embeddings, html_main, jaccard, langid, licenses, line_crf, media, mixing, pii, token_files

QUERIES = {
    "op1_pii_spans": pii.op1,
    "op2_language_id": langid.op2,
    "op3_bpe_tree": bpe_tree.op3,
    "op4_embedding_dedup": embeddings.op4,
    "op5_ngram_jaccard": jaccard.op5,
    "op6_token_files": token_files.op6,
    "op7_mix_sources": mixing.op7,
    "op8_license_scan": licenses.op8,
    "op9_html_main_text": html_main.op9,
    "op10_media_columns": media.op10,
    "op11_quality_lines": line_crf.op11,
    "op12_source_divergence": divergence.op12,
    "op13_tokenizer_alignment": alignment.op13,
}

SQL = {
    "op7_mix_sources": mixing.OP7_SQL,
    "op11_quality_lines": line_crf.op11,
    "op12_source_divergence": divergence.OP12_SQL,
}
