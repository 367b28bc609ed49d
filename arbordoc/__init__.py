"""Spark-native analytics over collections of JSON-shaped documents."""

from .session import get_session, table

__all__ = ["get_session", "table"]
