"""tradeloom: wholesale (B2B) sales analytics as composable PySpark DataFrame operators."""

from tradeloom.session import build_session

__all__ = ["build_session"]
