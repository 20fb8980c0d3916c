"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .ctph import op3_ctph
from .fim import OP11_SQL, op11_fim
from .langid import op10_langid
from .mixing import op6_mixing
from .neighbours import OP5_SQL, op5_neighbours
from .ngrams import op7_ngram_jaccard
from .packing import op1_packing
from .quality import op9_quality
from .records import op4_records
from .suffixes import op2_suffixes
from .superminhash import op13_superminhash
from .trie import OP12_SQL, op12_trie
from .warc import OP8_SQL, op8_warc

QUERIES = [op1_packing, op2_suffixes, op3_ctph, op4_records, op5_neighbours, op6_mixing, op7_ngram_jaccard, op8_warc, op9_quality, op10_langid, op11_fim, op12_trie, op13_superminhash]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_neighbours": OP5_SQL, "op8_warc": OP8_SQL, "op11_fim": OP11_SQL, "op12_trie": OP12_SQL}
