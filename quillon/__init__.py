"""A Spark-first engine for hybrid SQL, vector search and corpus processing."""
