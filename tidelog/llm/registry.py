"""Queries of the subpackage and the SQL that they are held against, where SQL can express them."""

from __future__ import annotations

from .langid import op5_ppm_langid
from .licences import op8_licence_scan
from .maxent import op10_maxent_lm
from .minhash import OP3_SQL, op3_bbit_minhash
from .mixing import OP9_SQL, op9_wfq_mix
from .neighbours import OP1_SQL, op1_pivot_range_join
from .packing import op6_binary_packing
from .sketch import op7_bottom_k
from .suffixes import OP2_SQL, op2_log_suffix
from .toxicity import op4_mil_toxicity

QUERIES = {
    "op1_pivot_range_join": op1_pivot_range_join,
    "op2_log_suffix": op2_log_suffix,
    "op3_bbit_minhash": op3_bbit_minhash,
    "op4_mil_toxicity": op4_mil_toxicity,
    "op5_ppm_langid": op5_ppm_langid,
    "op6_binary_packing": op6_binary_packing,
    "op7_bottom_k": op7_bottom_k,
    "op8_licence_scan": op8_licence_scan,
    "op9_wfq_mix": op9_wfq_mix,
    "op10_maxent_lm": op10_maxent_lm,
}

ORACLES = {
    "op1_pivot_range_join": OP1_SQL,
    "op2_log_suffix": OP2_SQL,
    "op3_bbit_minhash": OP3_SQL,
    "op9_wfq_mix": OP9_SQL,
}
