"""All registered queries."""

from docloom.plans import chunk_queries, context_queries, nlp_queries, rule_queries, search_queries, technical_queries  # noqa: F401
from docloom.plans.registry import QUERIES

__all__ = ["QUERIES"]
