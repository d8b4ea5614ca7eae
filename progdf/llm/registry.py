"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import audio, bpe, centroids, html, language, licences, minhash, mixing, neighbours, periodic, quality, substring, tokencount

QUERIES = {
    "op1_minhash_dedup": minhash.op1_minhash_dedup,
    "op2_quality": quality.op2_quality,
    "op3_nearest": neighbours.op3_nearest,
    "op4_media_audio": audio.op4_media_audio,
    "op5_language": language.op5_language,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_main_text": html.op7_main_text,
    "op8_bpe": bpe.op8_bpe,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_licence_scan": licences.op10_licence_scan,
    "op11_centroids": centroids.op11_centroids,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_token_counts": tokencount.op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": substring.OP6_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_licence_scan": licences.OP10_SQL,
    "op11_centroids": centroids.OP11_SQL,
}
