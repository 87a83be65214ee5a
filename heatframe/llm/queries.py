"""Imports every query module of this package, which registers its queries."""

from heatframe.llm import manifest_queries, screen_queries, similarity_queries, token_queries, web_queries  # noqa: F401
from heatframe.llm.registry import ORACLES, QUERIES  # noqa: F401
