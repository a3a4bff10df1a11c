"""All registered queries of the findings engine and their SQL."""

from __future__ import annotations

from . import corpus_queries, inventory_queries, log_queries

ALL = [*corpus_queries.QUERIES, *log_queries.QUERIES, *inventory_queries.QUERIES]
QUERIES = {q.name: q.run for q in ALL}
ORACLES = {q.name: q.sql for q in ALL if q.sql}
