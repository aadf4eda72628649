"""Importing this module registers every query."""

from fjelldoc.plans import chat_queries, chunk_queries, geo_queries, ingest_queries, search_queries, shape_queries, stream_queries, text_queries  # noqa: F401
from fjelldoc.plans.registry import ORACLES, QUERIES, bound_queries  # noqa: F401
