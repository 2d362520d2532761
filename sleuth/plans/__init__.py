"""Plan patterns (distributed global order) and the query registry."""
