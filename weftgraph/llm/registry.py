"""Queries and SQL of the operators, for ``__spark_entry__``."""

from __future__ import annotations

from . import decontaminate, langid, lm, mix, neardup, quality, secrets, shard, substring, topk

QUERIES = {
    "op1_decontaminate": decontaminate.query,
    "op2_quality": quality.query,
    "op3_neardup": neardup.query,
    "op4_secrets": secrets.query,
    "op5_language": langid.query,
    "op6_substring": substring.query,
    "op7_topk": topk.query,
    "op8_shard": shard.query,
    "op9_mix": mix.query,
    "op10_lm": lm.query,
}
SQL = {"op1_decontaminate": decontaminate.SQL, "op3_neardup": neardup.SQL, "op6_substring": substring.SQL, "op7_topk": topk.SQL}
