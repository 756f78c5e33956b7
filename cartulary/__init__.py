"""Document collections as a queryable knowledge graph, on Spark."""
