"""All queries of the library by name, and the SQL that each is checked against.

Each module of operators brings a mapping name -> (spark, sf_dir) -> DataFrame and, where SQL
can express the query, the DuckDB SQL of the same name.
"""

from corpusloom.plans import corpus_queries, graph_queries, lifecycle_queries, matching_queries, model_queries, relation_queries, search_queries, vault_queries

_MODULES = (search_queries, corpus_queries, graph_queries, matching_queries, lifecycle_queries, vault_queries, model_queries, relation_queries)

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
