"""Column functions: Spark expressions only, no Python UDF except romanisation."""
