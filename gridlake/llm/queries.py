"""Registered queries of the subpackage, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from gridlake.llm.alignment import op13_alignment
from gridlake.llm.bpe import op3_bpe
from gridlake.llm.divergence import SQL as DIVERGENCE_SQL
from gridlake.llm.divergence import op12_divergence
from gridlake.llm.language import language_pages, op8_language
from gridlake.llm.lm import op9_lm
from gridlake.llm.mixing import op10_mixing
from gridlake.llm.neardup import op6_neardup
from gridlake.llm.quality import SQL as QUALITY_SQL
from gridlake.llm.quality import op4_quality
from gridlake.llm.secrets import op7_secrets
from gridlake.llm.sharding import op2_sharding
from gridlake.llm.topk import SQL as TOPK_SQL
from gridlake.llm.topk import op1_topk
from gridlake.llm.toxicity import op5_toxicity
from gridlake.llm.winnowing import op11_winnowing

QUERIES = {
    "op1_topk": op1_topk,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_neardup": op6_neardup,
    "op7_secrets": op7_secrets,
    "op8_language": op8_language,
    "op9_lm": op9_lm,
    "op10_mixing": op10_mixing,
    "op11_winnowing": op11_winnowing,
    "op12_divergence": op12_divergence,
    "op13_alignment": op13_alignment,
    "language_pages": language_pages,
}

ORACLES: dict[str, str] = {
    "op1_topk": TOPK_SQL,
    "op4_quality": QUALITY_SQL,
    "op12_divergence": DIVERGENCE_SQL,
}
