"""The numbered queries over a folder of tables, and their SQL checks."""

from __future__ import annotations

from haberdash.llm.decontaminate import OP5_SQL, op5_decontamination
from haberdash.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from haberdash.llm.katz import op4_katz
from haberdash.llm.line_dedup import op9_line_dedup
from haberdash.llm.mixing import OP3_SQL, op3_mixing
from haberdash.llm.nearest import OP8_SQL, op8_nearest
from haberdash.llm.pii import op2_pii
from haberdash.llm.spelling import op12_spelling
from haberdash.llm.substring_dedup import OP11_SQL, op11_substring_dedup
from haberdash.llm.toxicity import op7_toxicity
from haberdash.llm.url_rules import OP6_SQL, op6_url_filter
from haberdash.llm.warc import OP10_SQL, op10_warc
from haberdash.llm.whitening import op13_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_jaccard_join,
        op2_pii,
        op3_mixing,
        op4_katz,
        op5_decontamination,
        op6_url_filter,
        op7_toxicity,
        op8_nearest,
        op9_line_dedup,
        op10_warc,
        op11_substring_dedup,
        op12_spelling,
        op13_whitening,
    )
}

ORACLE_SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op3_mixing": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_nearest": OP8_SQL,
    "op10_warc": OP10_SQL,
    "op11_substring_dedup": OP11_SQL,
}
