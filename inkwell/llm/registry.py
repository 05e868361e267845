"""Queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from inkwell.llm.ann import op6_ann
from inkwell.llm.chat import op7_chat
from inkwell.llm.collocations import COLLOCATIONS_SQL, op11_collocations
from inkwell.llm.htmltext import op10_htmltext
from inkwell.llm.langid import op1_langid
from inkwell.llm.lexical import LEXICAL_SQL, op12_lexical
from inkwell.llm.mixing import op8_mixing
from inkwell.llm.pieces import op9_pieces
from inkwell.llm.secrets import op3_secrets
from inkwell.llm.sharding import op2_sharding
from inkwell.llm.simhash import op5_simhash
from inkwell.llm.sketch import op4_fingerprints
from inkwell.llm.toxicity import op13_toxicity

QUERIES = {
    "op1_langid": op1_langid,
    "op2_sharding": op2_sharding,
    "op3_secrets": op3_secrets,
    "op4_fingerprints": op4_fingerprints,
    "op5_simhash": op5_simhash,
    "op6_ann": op6_ann,
    "op7_chat": op7_chat,
    "op8_mixing": op8_mixing,
    "op9_pieces": op9_pieces,
    "op10_htmltext": op10_htmltext,
    "op11_collocations": op11_collocations,
    "op12_lexical": op12_lexical,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op11_collocations": COLLOCATIONS_SQL, "op12_lexical": LEXICAL_SQL}
