"""Queries of the subpackage, and of the pipeline at the repository's top."""

from __future__ import annotations

import corpus_pipeline
from kinfold.llm.centroids import OP11_SQL, op11_centroid_clusters
from kinfold.llm.decontaminate import OP10_SQL, op10_decontaminate
from kinfold.llm.fingerprint import op1_fingerprint
from kinfold.llm.html_text import op6_html_text
from kinfold.llm.mixing import op8_mixing
from kinfold.llm.neardup import op9_neardup
from kinfold.llm.quality import op4_quality
from kinfold.llm.sharding import op7_sharding
from kinfold.llm.substring_dedup import op5_substring_dedup
from kinfold.llm.token_output import op3_token_output
from kinfold.llm.token_count import op12_token_count
from kinfold.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_toxicity": op2_toxicity,
    "op3_token_output": op3_token_output,
    "op4_quality": op4_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_text": op6_html_text,
    "op7_sharding": op7_sharding,
    "op8_mixing": op8_mixing,
    "op9_neardup": op9_neardup,
    "op10_decontaminate": op10_decontaminate,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_token_count": op12_token_count,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op10_decontaminate": OP10_SQL, "op11_centroid_clusters": OP11_SQL}
