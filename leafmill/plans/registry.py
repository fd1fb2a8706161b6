"""All queries of the conversion operators, with their SQL."""

from leafmill.plans import export_queries, page_queries, page_sql, queries, space_queries, sql, tree_queries

QUERIES = queries.QUERIES | page_queries.QUERIES | tree_queries.QUERIES | export_queries.QUERIES | space_queries.QUERIES
SQL = sql.SQL | page_sql.SQL | tree_queries.SQL | export_queries.SQL | space_queries.SQL
FLAGSHIP = "toc_index"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
