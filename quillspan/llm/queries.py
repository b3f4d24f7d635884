"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op1_bpe
from .divergence import SQL as DIVERGENCE_SQL
from .divergence import op13_source_divergence
from .gridjoin import SQL as EMBEDDING_SQL
from .gridjoin import op3_embedding_dedup
from .importance import SQL as IMPORTANCE_SQL
from .importance import op11_importance_resampling
from .langid import op2_language_id
from .packing import op8_packing
from .pii import op4_pii
from .quality import op12_quality
from .simhash import op9_simhash
from .suffixdedup import op10_suffix_dedup
from .tokencount import op7_token_counts
from .tokenfile import op5_token_shards
from .topk import SQL as TOP_K_SQL
from .topk import op6_top_k

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language_id": op2_language_id,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii": op4_pii,
    "op5_token_shards": op5_token_shards,
    "op6_top_k": op6_top_k,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality": op12_quality,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op3_embedding_dedup": EMBEDDING_SQL, "op6_top_k": TOP_K_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op13_source_divergence": DIVERGENCE_SQL}
