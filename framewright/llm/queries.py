"""The queries of this subpackage, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from . import centroids, grace, turns, urls, warc
from .centroids import op11_centroids
from .grace import op5_exact_dedup
from .langid import op10_language
from .packing import op4_packing
from .pii import op1_personal_data
from .pieces import op8_pieces
from .recompression import op9_repeats
from .sampling import op2_fingerprints
from .simhash import op7_simhash
from .toxicity import op3_toxicity
from .turns import op13_turns
from .urls import op12_urls
from .warc import op6_warc

QUERIES = {
    "op1_personal_data": op1_personal_data,
    "op2_fingerprints": op2_fingerprints,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_warc": op6_warc,
    "op7_simhash": op7_simhash,
    "op8_pieces": op8_pieces,
    "op9_repeats": op9_repeats,
    "op10_language": op10_language,
    "op11_centroids": op11_centroids,
    "op12_urls": op12_urls,
    "op13_turns": op13_turns,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": grace.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op11_centroids": centroids.OP11_SQL,
    "op12_urls": urls.OP12_SQL,
    "op13_turns": turns.OP13_SQL,
}
