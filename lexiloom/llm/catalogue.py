"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import chunks, codes, counts, media, merkle, mixing, neardup, packing, ppm, quality, sampling, secrets, topk

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality_classifier,
        secrets.op2_secret_scans,
        ppm.op3_lm_scoring,
        media.op4_media_columns,
        chunks.op5_substring_dedup,
        counts.op6_token_counts,
        topk.op7_topk_search,
        packing.op8_packing,
        neardup.op9_minhash_near_dedup,
        sampling.op10_sampled_segmentations,
        merkle.op11_merkle_manifest,
        codes.op12_vector_codes,
        mixing.op13_source_mixing,
    )
}
ORACLE = {"op7_topk_search": topk.OP7_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_source_mixing": mixing.OP13_SQL}
