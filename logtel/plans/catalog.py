"""All registered queries."""

from __future__ import annotations

from logtel.plans import (  # noqa: F401
    file_queries,
    ingest_queries,
    log_queries,
    poll_queries,
    run_queries,
    source_queries,
    stream_queries,
)
from logtel.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
