"""All registered queries of this subpackage."""

from . import fingerprint_queries, license_queries, merkle_queries, mixing_queries, near_vector_queries, ngram_queries, piece_queries, quality_queries, spelling_queries, substring_queries, suffix_queries, topk_queries, url_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
