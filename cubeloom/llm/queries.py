"""The operators' registered queries and their SQL."""

from __future__ import annotations

from cubeloom.llm import decontam, hostrules, licenses, negatives
from cubeloom.llm.alignment import op12
from cubeloom.llm.html import op5
from cubeloom.llm.jaccard import op2
from cubeloom.llm.langid import op1
from cubeloom.llm.packing import op4
from cubeloom.llm.pii import op8
from cubeloom.llm.secrets import op7
from cubeloom.llm.substrings import op3
from cubeloom.llm.toxicity import op9

QUERIES = {
    "op1_language_id": op1,
    "op2_jaccard_join": op2,
    "op3_substring_dedup": op3,
    "op4_packing": op4,
    "op5_main_text": op5,
    "op6_host_rules": hostrules.op6,
    "op7_secrets": op7,
    "op8_pii": op8,
    "op9_toxicity": op9,
    "op10_decontamination": decontam.op10,
    "op11_license_scan": licenses.op11,
    "op12_token_alignment": op12,
    "op13_hard_negatives": negatives.op13,
}

ORACLE_SQL = {"op6_host_rules": hostrules.SQL, "op10_decontamination": decontam.SQL, "op11_license_scan": licenses.SQL, "op13_hard_negatives": negatives.SQL}
