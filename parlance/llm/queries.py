"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from .licences import op1_licence_scan
from .linededup import OP4_SQL, op4_line_dedup
from .media import op6_media_columns
from .merkle import OP13_SQL, op13_merkle_manifest
from .minhash import OP5_SQL, op5_minhash_dedup
from .mixing import OP2_SQL, op2_mix_sources
from .order import op9_training_order
from .pieces import op7_sentencepiece
from .pii import op3_pii_pseudonyms
from .quality import OP8_SQL, op8_quality_rules
from .shapes import OP12_SQL, op12_schema_inference
from .sharding import OP10_SQL, op10_stratified_shards
from .toxicity import op11_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_licence_scan, op2_mix_sources, op3_pii_pseudonyms, op4_line_dedup, op5_minhash_dedup, op6_media_columns, op7_sentencepiece, op8_quality_rules, op9_training_order, op10_stratified_shards, op11_toxicity, op12_schema_inference, op13_merkle_manifest)
}
#: Not in SQL: trained models (1, 11), keyed permutations inside texts (3), stored
#: bytes (6, 9), a lattice search (7). Tests hold each of these against brute force.
SQL = {"op2_mix_sources": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_minhash_dedup": OP5_SQL, "op8_quality_rules": OP8_SQL, "op10_stratified_shards": OP10_SQL, "op12_schema_inference": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
