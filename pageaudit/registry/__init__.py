"""All registered queries; importing a module registers what it holds."""

from pageaudit.registry import (  # noqa: F401
    classify_queries,
    compare_queries,
    journey_queries,
    page_queries,
    stream_queries,
    text_queries,
)
from pageaudit.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
