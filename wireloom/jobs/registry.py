"""All queries of this library, by name, with DuckDB SQL beside each that SQL can express."""

from . import flow_queries, more_queries, web_queries

QUERIES = web_queries.QUERIES | flow_queries.QUERIES | more_queries.QUERIES
ORACLE_SQL = web_queries.ORACLE_SQL | flow_queries.ORACLE_SQL | more_queries.ORACLE_SQL
