"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .decontaminate import op5_decontamination
from .dedup import op7_near_dedup
from .html_text import op3_html_text
from .language import op6_language_id
from . import oracles
from .licenses import op4_license_scan, oracle
from .mixing import op1_mixing
from .tokencount import op2_token_counts
from .tokenfile import op10_token_output
from .toxicity import op8_toxicity
from .vectors import op9_nearest

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_html_text": op3_html_text,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_nearest": op9_nearest,
    "op10_token_output": op10_token_output,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op4_license_scan": oracle(),
    "op7_near_dedup": oracles.NEAR_DEDUP,
    "op9_nearest": oracles.NEAREST,
}
