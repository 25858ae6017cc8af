"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm import embdup, media, minhash, mixing, packing, pii, quality, sharding, toxicity, warc

_MODULES = {
    "op1_mixing": mixing,
    "op2_pii": pii,
    "op3_media": media,
    "op4_warc": warc,
    "op5_quality": quality,
    "op6_minhash": minhash,
    "op7_sharding": sharding,
    "op8_embedding": embdup,
    "op9_toxicity": toxicity,
    "op10_packing": packing,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLE_SQL = {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
