"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import fingerprints, html_text, jaccard, mixing, pieces, quality, token_counts, token_frames, urls, warc

QUERIES = {
    "op1_merkle_fingerprints": fingerprints.op1_merkle_fingerprints,
    "op2_html_extract": html_text.op2_html_extract,
    "op3_token_frames": token_frames.op3_token_frames,
    "op4_url_filter": urls.op4_url_filter,
    "op5_warc": warc.op5_warc,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_curriculum_mix": mixing.op9_curriculum_mix,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
ORACLES = {
    "op1_merkle_fingerprints": fingerprints.OP1_SQL,
    "op4_url_filter": urls.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_curriculum_mix": mixing.OP9_SQL,
}
