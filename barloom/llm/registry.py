"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocation, crosstok, images, jaccard, langid, licenses, mixing, nearest, packing, quality, sharding, tokenbin, urlfilter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_external_shuffle": sharding.op2_external_shuffle,
    "op3_bit_plane_tokens": tokenbin.op3_bit_plane_tokens,
    "op4_pivotal_mix": mixing.op4_pivotal_mix,
    "op5_hilbert_pack": packing.op5_hilbert_pack,
    "op6_local_descriptors": images.op6_local_descriptors,
    "op7_word_crf": langid.op7_word_crf,
    "op8_temporal_lists": urlfilter.op8_temporal_lists,
    "op9_size_aware_join": jaccard.op9_size_aware_join,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_token_spans": crosstok.op11_token_spans,
    "op12_adaptive_scan": nearest.op12_adaptive_scan,
    "op13_tiled_collocations": collocation.op13_tiled_collocations,
}
ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.OP1_SQL,
    "op8_temporal_lists": urlfilter.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op13_tiled_collocations": collocation.OP13_SQL,
}
