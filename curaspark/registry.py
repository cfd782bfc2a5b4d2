"""All registered queries with their SQL counterparts."""

from curaspark.plans import session_queries, unit_queries

QUERIES = {**unit_queries.QUERIES, **session_queries.QUERIES}
ORACLE = {**unit_queries.ORACLE, **session_queries.ORACLE}
