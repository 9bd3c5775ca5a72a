"""All registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import document_queries, glyph_queries, mention_queries, metric_queries, relation_queries, section_queries, supervision_queries, text_queries, token_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (document_queries, text_queries, token_queries, relation_queries, mention_queries, supervision_queries, section_queries, metric_queries, glyph_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
