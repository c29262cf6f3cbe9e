"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import conversation, decontaminate, fingerprint, langid, license_scan, lm_score, ngram_join, pack, pii, token_count, toxicity, url_filter, whitening

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_lm_scoring": lm_score.op4_lm_scoring,
    "op5_pii": pii.op5_pii,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_document_fingerprints": fingerprint.op8_document_fingerprints,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_best_fit_packing": pack.op10_best_fit_packing,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_token_counts": token_count.op12_token_counts,
    "op13_conversation_repair": conversation.op13_conversation_repair,
}
SQL = {"op6_url_filter": url_filter.OP6_SQL}
