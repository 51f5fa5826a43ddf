"""Vector river networks from gridded waterway probabilities, as Spark DataFrames keyed by drainage basin."""
