"""Column functions: pure Spark expressions, no Python UDF."""
