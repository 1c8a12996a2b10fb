"""All queries of the engine and the SQL of those that SQL can express.

A query takes the session and a data folder and reads whole tables. Searches
take as queries every row whose id is divisible by 100."""

from __future__ import annotations

from lodestar.plans import queries_approximate, queries_codecs, queries_evaluation, queries_indexes, queries_search, queries_walks
from lodestar.plans.registry import ORACLE_SQL, QUERIES

MODULES = (queries_search, queries_evaluation, queries_approximate, queries_indexes, queries_codecs, queries_walks)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
