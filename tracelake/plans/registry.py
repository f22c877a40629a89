"""All registered queries of the library: importing the modules registers them."""

from tracelake.plans import entity_queries, evidence_queries, graph_queries, more_queries, related_queries, review_queries  # noqa: F401
from tracelake.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
