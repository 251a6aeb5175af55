"""Registered queries of the training-data operators."""

from __future__ import annotations

import corpus_pipeline
from armlift.llm.bpe import op3_encode_documents
from armlift.llm.caps import op12_link_near_vectors
from armlift.llm.fingerprints import op9_fingerprint_documents
from armlift.llm.lm import op2_score_texts
from armlift.llm.mixing import op7_mix_documents
from armlift.llm.near import op4_group_near_duplicates
from armlift.llm.neighbours import op6_nearest_neighbours
from armlift.llm.pii import op5_find_personal_data
from armlift.llm.quality import op8_score_quality
from armlift.llm.repeats import op10_remove_repeats
from armlift.llm.search import op11_rank_documents
from armlift.llm.sharding import op1_shard_documents
from armlift.llm.spelling import op13_group_spellings

QUERIES = {
    "op1_shard_documents": op1_shard_documents,
    "op2_score_texts": op2_score_texts,
    "op3_encode_documents": op3_encode_documents,
    "op4_group_near_duplicates": op4_group_near_duplicates,
    "op5_find_personal_data": op5_find_personal_data,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_mix_documents": op7_mix_documents,
    "op8_score_quality": op8_score_quality,
    "op9_fingerprint_documents": op9_fingerprint_documents,
    "op10_remove_repeats": op10_remove_repeats,
    "op11_rank_documents": op11_rank_documents,
    "op12_link_near_vectors": op12_link_near_vectors,
    "op13_group_spellings": op13_group_spellings,
    "pipeline": corpus_pipeline.run,
}
