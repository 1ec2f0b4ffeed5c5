"""A graph query, rule and text engine on Spark DataFrames."""
