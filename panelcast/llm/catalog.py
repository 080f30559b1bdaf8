"""All queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from panelcast.llm.queries_dedup import op9_ngram_join
from panelcast.llm.queries_fingerprints import op1_imatch
from panelcast.llm.queries_lines import OP11_SQL, op11_lines
from panelcast.llm.queries_mix import op7_mix
from panelcast.llm.queries_pages import op3_urls, op5_html
from panelcast.llm.queries_privacy import op4_pii, op6_secrets
from panelcast.llm.queries_quality import op10_quality
from panelcast.llm.queries_runs import op12_runs
from panelcast.llm.queries_tokens import OP2_SQL, op2_chat, op8_bpe
from panelcast.llm.queries_vectors import op13_whiten

QUERIES = {
    "op1_imatch": op1_imatch,
    "op2_chat": op2_chat,
    "op3_urls": op3_urls,
    "op4_pii": op4_pii,
    "op5_html": op5_html,
    "op6_secrets": op6_secrets,
    "op7_mix": op7_mix,
    "op8_bpe": op8_bpe,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality": op10_quality,
    "op11_lines": op11_lines,
    "op12_runs": op12_runs,
    "op13_whiten": op13_whiten,
}

ORACLES: dict[str, str] = {
    "op2_chat": OP2_SQL,
    "op11_lines": OP11_SQL,
}
