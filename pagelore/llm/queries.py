"""The training-data queries by name, and SQL where it can express them."""

from __future__ import annotations

from . import embeddings, lm
from .decontaminate import op10_decontaminate
from .embeddings import op8_embedding_dedup
from .language import op6_language
from .licenses import op4_license_scan
from .lm import op9_lm_score
from .pack import op1_pack
from .pii import op2_pii
from .quality import op5_quality
from .shard import op3_shard
from .simhash import op7_simhash


def queries() -> dict:
    return {f.__name__: f for f in (op1_pack, op2_pii, op3_shard, op4_license_scan, op5_quality, op6_language, op7_simhash, op8_embedding_dedup, op9_lm_score, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_dedup": embeddings.SQL, "op9_lm_score": lm.SQL}
