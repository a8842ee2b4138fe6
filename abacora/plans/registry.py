"""Registered queries of the library and their SQL equivalents."""

from __future__ import annotations

from . import corpus_queries, curation_queries, record_queries, scoring_queries, target_queries

QUERIES = {**scoring_queries.QUERIES, **corpus_queries.QUERIES, **curation_queries.QUERIES, **record_queries.QUERIES, **target_queries.QUERIES}
ORACLES = {**scoring_queries.ORACLES, **corpus_queries.ORACLES, **curation_queries.ORACLES, **record_queries.ORACLES, **target_queries.ORACLES}
