"""Every registered query of the engine with its oracle SQL."""

from . import analysis_queries, campaign_queries, connector_queries, relational_queries, report_queries, rewrite_queries, rule_queries, source_queries, stream_queries, text_queries, training_queries, usage_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "dedup_cluster_summary"
