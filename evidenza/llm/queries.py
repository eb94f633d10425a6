"""Queries of this subpackage by name, and the SQL that some of them equal."""

from __future__ import annotations

from . import clusters, codes, lines, media, minhash, mixing, packing, quality, search, secrets, sharding, suffixes, tokens

QUERIES = {
    "op1_suffix": suffixes.op1_suffix,
    "op2_mix": mixing.op2_mix,
    "op3_quality": quality.op3_quality,
    "op4_lines": lines.op4_lines,
    "op5_secrets": secrets.op5_secrets,
    "op6_shard": sharding.op6_shard,
    "op7_pack": packing.op7_pack,
    "op8_minhash": minhash.op8_minhash,
    "op9_topk": search.op9_topk,
    "op10_media": media.op10_media,
    "op11_tokens": tokens.op11_tokens,
    "op12_codes": codes.op12_codes,
    "op13_clusters": clusters.op13_clusters,
}
ORACLE_SQL: dict[str, str] = {"op4_lines": lines.OP4_SQL, "op9_topk": search.OP9_SQL, "op12_codes": codes.OP12_SQL, "op13_clusters": clusters.OP13_SQL}
