"""All registered queries of the library."""

from __future__ import annotations

from . import order_queries, question_queries, text_queries

QUERIES: dict = {}
SQL: dict = {}
for module in (order_queries, question_queries, text_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
