"""Queries of the numbered operators and, where SQL can say it, their oracles."""

from __future__ import annotations

from quillmark.llm.bpe import op4_bpe
from quillmark.llm.extraction import op11_pages
from quillmark.llm.hosts import OP3_SQL, op3_host_rules
from quillmark.llm.minhash import op2_minhash
from quillmark.llm.mixing import OP7_SQL, op7_mixing
from quillmark.llm.passages import op8_passages
from quillmark.llm.quality import op10_quality
from quillmark.llm.runs import OP13_SQL, op13_runs
from quillmark.llm.secrets import op6_secrets
from quillmark.llm.spelling import OP12_SQL, op12_spelling
from quillmark.llm.suffixes import op5_suffixes
from quillmark.llm.toxicity import op1_toxicity
from quillmark.llm.vectors import op9_vectors

QUERIES = {
    "op4_bpe": op4_bpe,
    "op5_suffixes": op5_suffixes,
    "op8_passages": op8_passages,
    "op2_minhash": op2_minhash,
    "op9_vectors": op9_vectors,
    "op1_toxicity": op1_toxicity,
    "op10_quality": op10_quality,
    "op3_host_rules": op3_host_rules,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op11_pages": op11_pages,
    "op12_spelling": op12_spelling,
    "op13_runs": op13_runs,
}

ORACLE = {
    "op3_host_rules": OP3_SQL,
    "op7_mixing": OP7_SQL,
    "op12_spelling": OP12_SQL,
    "op13_runs": OP13_SQL,
}
