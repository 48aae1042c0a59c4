"""lexmill: document search and retrieval on Spark DataFrames."""
