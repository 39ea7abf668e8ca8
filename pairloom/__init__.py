"""Spark jobs over bipartite interaction graphs."""
