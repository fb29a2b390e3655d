"""The package's queries, and their SQL where there is any."""

from __future__ import annotations

from homescore.llm.decontamination import op11_ngram_decontamination
from homescore.llm.embedding_dedup import op9_hnsw_near_vectors
from homescore.llm.hard_negatives import op13_zone_map_hard_negatives
from homescore.llm.language import op7_hyperdimensional_language
from homescore.llm.near_dedup import op2_lsh_forest_near_dedup
from homescore.llm.oracle import ORACLE
from homescore.llm.packing import op6_vector_packing
from homescore.llm.prefix_trie import op12_euler_tour_prefix_trie
from homescore.llm.quality_model import op8_subword_quality
from homescore.llm.quality_rules import op10_llr_quality_rules
from homescore.llm.secrets import op4_token_efficiency_secrets
from homescore.llm.sentencepieces import op3_wfst_sentencepiece
from homescore.llm.substring_dedup import op1_relative_lz_dedup
from homescore.llm.token_files import op5_range_coded_ids

QUERIES = {
    "op1_relative_lz_dedup": op1_relative_lz_dedup,
    "op2_lsh_forest_near_dedup": op2_lsh_forest_near_dedup,
    "op3_wfst_sentencepiece": op3_wfst_sentencepiece,
    "op4_token_efficiency_secrets": op4_token_efficiency_secrets,
    "op5_range_coded_ids": op5_range_coded_ids,
    "op6_vector_packing": op6_vector_packing,
    "op7_hyperdimensional_language": op7_hyperdimensional_language,
    "op8_subword_quality": op8_subword_quality,
    "op9_hnsw_near_vectors": op9_hnsw_near_vectors,
    "op10_llr_quality_rules": op10_llr_quality_rules,
    "op11_ngram_decontamination": op11_ngram_decontamination,
    "op12_euler_tour_prefix_trie": op12_euler_tour_prefix_trie,
    "op13_zone_map_hard_negatives": op13_zone_map_hard_negatives,
}

__all__ = ["ORACLE", "QUERIES"]
