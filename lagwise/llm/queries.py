"""All queries of this subpackage, and the SQL of those that have it."""

from __future__ import annotations

from lagwise.llm import queries_a, queries_b, queries_c

QUERIES = {**queries_a.QUERIES, **queries_b.QUERIES, **queries_c.QUERIES}
SQL = {**queries_a.SQL, **queries_b.SQL, **queries_c.SQL}
