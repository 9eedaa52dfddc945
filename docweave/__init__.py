"""Document analytics as Spark DataFrames: extraction, scoring, reporting."""
