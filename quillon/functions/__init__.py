"""Vector distances and SQLite-compatible functions as Spark SQL expressions."""
