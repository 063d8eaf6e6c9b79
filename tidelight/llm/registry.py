"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .decontaminate import op8_decontaminate
from .html_text import op4_html_text
from .language_id import op1_language_id
from .licences import op2_licences
from .near_duplicates import op5_near_duplicates
from .periodic_runs import OP13_SQL, op13_periodic_runs
from .pii import op10_pii
from .role_repair import OP12_SQL, op12_role_repair
from .topk import OP7_SQL, op7_topk
from .toxicity import op11_toxicity
from .urls import op6_url_filter
from .warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_licences": op2_licences,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_text": op4_html_text,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_url_filter": op6_url_filter,
    "op7_topk": op7_topk,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "op11_toxicity": op11_toxicity,
    "op12_role_repair": op12_role_repair,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {"op7_topk": OP7_SQL, "op9_warc": OP9_SQL, "op12_role_repair": OP12_SQL, "op13_periodic_runs": OP13_SQL}
