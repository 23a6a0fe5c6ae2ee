"""The registered queries of the training-data operators; none of them is expressible in SQL."""

from __future__ import annotations

from foliant.llm.additive_index import op2_additive_ann
from foliant.llm.decontaminate import op7_decontaminate
from foliant.llm.html_extract import op3_html_extract
from foliant.llm.jaccard_join import op4_jaccard_join
from foliant.llm.langid import op8_langid
from foliant.llm.packing import op6_pack_binary, op10_min_slack
from foliant.llm.resharding import op5_reshard
from foliant.llm.rollup import op9_token_counts
from foliant.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_additive_ann": op2_additive_ann,
    "op3_html_extract": op3_html_extract,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_reshard": op5_reshard,
    "op6_pack_binary": op6_pack_binary,
    "op7_decontaminate": op7_decontaminate,
    "op8_langid": op8_langid,
    "op9_token_counts": op9_token_counts,
    "op10_min_slack": op10_min_slack,
}

ORACLE_SQL: dict[str, str] = {}
