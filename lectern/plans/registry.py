"""All registered queries and, where SQL can express them, their DuckDB twins."""

from lectern.plans import document_queries, io_queries, profile_queries, quality_queries, report_queries, speech_queries, stream_queries, topic_queries  # noqa: F401
from lectern.plans.base import ORACLE, QUERIES, query, table  # noqa: F401
