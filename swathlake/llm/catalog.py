"""The operators' queries, each over its whole table."""

from . import bpe, codec, jaccard, language, manifest, media, mixing, packing, passages, secrets, topk, whitening, wrappers

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_mixing_sources": mixing.op4_mixing_sources,
    "op5_media_columns": media.op5_media_columns,
    "op6_html_extraction": wrappers.op6_html_extraction,
    "op7_top_k": topk.op7_top_k,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_substring_dedup": passages.op9_substring_dedup,
    "op10_token_ids": codec.op10_token_ids,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_byte_level_bpe": bpe.op13_byte_level_bpe,
}
ORACLES: dict[str, str] = {"op3_ngram_jaccard_join": jaccard.ORACLE, "op7_top_k": topk.ORACLE, "op11_merkle_manifest": manifest.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
