"""VectorSQL statements as Spark SQL, and their classification."""
