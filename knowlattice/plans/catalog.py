"""All named queries: importing the modules registers them."""

from . import citation_queries, context_queries, document_queries, graph_queries, lifecycle_queries, record_queries, search_queries, source_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
