"""Column builders: native Spark expressions over one row."""
