"""Name -> query and name -> oracle SQL of the retrieval engine."""

from docloom.plans import analytics_queries, chunk_queries, paper_queries, search_queries, stream_queries, upkeep_queries

_PARTS = (search_queries, analytics_queries, upkeep_queries, stream_queries, chunk_queries, paper_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
