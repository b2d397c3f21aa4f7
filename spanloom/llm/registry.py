"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from spanloom.llm import vector_search
from spanloom.llm.bpe import op10_bpe
from spanloom.llm.decontamination import op9_decontamination
from spanloom.llm.html_text import op4_html_text
from spanloom.llm.jaccard_join import op5_jaccard_join
from spanloom.llm.language import op2_language
from spanloom.llm.line_dedup import op7_line_dedup
from spanloom.llm.suffix_dedup import op8_suffix_dedup
from spanloom.llm.token_blocks import op1_token_blocks
from spanloom.llm.toxicity import op3_toxicity


def queries() -> dict:
    return {
        "op1_token_blocks": op1_token_blocks,
        "op2_language": op2_language,
        "op3_toxicity": op3_toxicity,
        "op4_html_text": op4_html_text,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_vector_search": vector_search.op6_vector_search,
        "op7_line_dedup": op7_line_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_decontamination": op9_decontamination,
        "op10_bpe": op10_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    out = {"op6_vector_search": vector_search.SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
