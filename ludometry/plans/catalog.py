"""All registered queries."""

from . import experiment_queries, feature_queries, funnel_queries, io_queries, kpi_queries, ltv_queries, model_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
