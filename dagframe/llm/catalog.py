"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from dagframe.llm.ann import op7_nearest
from dagframe.llm.language_model import op8_lm_scores
from dagframe.llm.licenses import OP9_SQL, op9_license_scan
from dagframe.llm.near_dedup import OP1_SQL, op1_minhash_dedup
from dagframe.llm.packing import op4_packing
from dagframe.llm.pieces import op5_sentencepiece
from dagframe.llm.quality_rules import OP10_SQL, op10_quality_rules
from dagframe.llm.secrets import op6_secret_scan
from dagframe.llm.suffix_dedup import OP2_SQL, op2_suffix_dedup
from dagframe.llm.url_filter import op3_url_filter

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_secret_scan": op6_secret_scan,
    "op7_nearest": op7_nearest,
    "op8_lm_scores": op8_lm_scores,
    "op9_license_scan": op9_license_scan,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_quality_rules": OP10_SQL,
}
