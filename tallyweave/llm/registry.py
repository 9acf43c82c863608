"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, ogg_media, packing, secret_scan, sharding, substring_dedup, toxicity, url_trust

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_mixing": mixing.op5_mixing,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_url_trust": url_trust.op8_url_trust,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_ogg_media": ogg_media.op10_ogg_media,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
