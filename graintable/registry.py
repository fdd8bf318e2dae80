"""Every query of the library by name, and its equivalent SQL."""

from __future__ import annotations

from .plans import corpus_queries, dialogue_queries, price_queries, store_queries

QUERIES = {**price_queries.QUERIES, **corpus_queries.QUERIES, **dialogue_queries.QUERIES, **store_queries.QUERIES}
ORACLES = {**price_queries.ORACLES, **corpus_queries.ORACLES, **dialogue_queries.ORACLES, **store_queries.ORACLES}
