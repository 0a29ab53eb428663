"""Retrieval-corpus jobs for Spark: ingest, chunk, index, search, cite, validate and evaluate as DataFrames."""
