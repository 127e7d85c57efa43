"""All registered queries of this subpackage."""

from riskloom.llm import (  # noqa: F401
    q_centroids,
    q_cover_tree,
    q_filter_audit,
    q_hilbert,
    q_licenses,
    q_lm_scoring,
    q_mixing,
    q_ngram_join,
    q_pieces,
    q_pseudonyms,
    q_quality,
    q_secrets,
    q_url_filter,
)
from riskloom.llm.registry import ORACLES, QUERIES  # noqa: F401
