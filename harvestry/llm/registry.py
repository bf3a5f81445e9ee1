"""The queries and SQL of this subpackage."""

from __future__ import annotations

from .chat import ORACLE as QUOTE_SQL
from .chat import op1_quote_linking
from .collocations import ORACLE as COLLOCATION_SQL
from .collocations import op12_collocations
from .exact_dedup import ORACLE as DEDUP_SQL
from .exact_dedup import op9_exact_dedup
from .flac import op5_flac_media
from .importance import ORACLE as RESAMPLING_SQL
from .importance import op11_importance_resampling
from .language import op3_language_bloom
from .suffix_dedup import op2_suffix_dedup
from .minhash import op6_oph_near_dedup
from .mixing import op4_pareto_mix
from .packing import op7_best_fit_packing
from .quality import op8_quality
from .sharding import op10_tiered_shards
from .toxicity import op13_toxicity


def queries() -> dict:
    return {f.__name__: f for f in (op1_quote_linking, op2_suffix_dedup, op3_language_bloom, op4_pareto_mix, op5_flac_media, op6_oph_near_dedup, op7_best_fit_packing, op8_quality, op9_exact_dedup, op10_tiered_shards, op11_importance_resampling, op12_collocations, op13_toxicity)}


def oracle_sql() -> dict:
    return {"op1_quote_linking": QUOTE_SQL, "op9_exact_dedup": DEDUP_SQL, "op11_importance_resampling": RESAMPLING_SQL, "op12_collocations": COLLOCATION_SQL}
