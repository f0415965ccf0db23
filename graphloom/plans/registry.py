"""All registered queries of the core engine and their SQL."""

from graphloom.plans import graph_queries, more_queries, path_queries, text_queries

QUERIES: dict = {**graph_queries.QUERIES, **text_queries.QUERIES, **more_queries.QUERIES, **path_queries.QUERIES}
ORACLE: dict = {**graph_queries.ORACLE, **text_queries.ORACLE, **more_queries.ORACLE, **path_queries.ORACLE}
