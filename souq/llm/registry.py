"""Registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_lookup_clusters
from .chat_repair import op4_chat_repair
from .decontaminate import OP1_SQL, op1_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .kneser_ney import op7_kneser_ney
from .minhash_dedup import op8_minhash_dedup
from .mixing import OP3_SQL, op3_mix_sources
from .paragraph_dedup import op9_paragraph_dedup
from .permutation_index import op5_permutation_index
from .quality import op6_quality_vote
from .secrets import OP13_SQL, op13_secret_scan
from .toxicity import op10_subword_toxicity
from .url_filter import OP2_SQL, op2_url_filter

QUERIES = {
    "op9_paragraph_dedup": op9_paragraph_dedup,
    "op7_kneser_ney": op7_kneser_ney,
    "op4_chat_repair": op4_chat_repair,
    "op2_url_filter": op2_url_filter,
    "op1_decontaminate": op1_decontaminate,
    "op5_permutation_index": op5_permutation_index,
    "op6_quality_vote": op6_quality_vote,
    "op10_subword_toxicity": op10_subword_toxicity,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op11_source_divergence": op11_source_divergence,
    "op12_lookup_clusters": op12_lookup_clusters,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE: dict[str, str] = {
    "op2_url_filter": OP2_SQL,
    "op1_decontaminate": OP1_SQL,
    "op3_mix_sources": OP3_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_lookup_clusters": OP12_SQL,
    "op13_secret_scan": OP13_SQL,
}
