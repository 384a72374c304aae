"""Full-text search and analytics over Spark DataFrames."""
