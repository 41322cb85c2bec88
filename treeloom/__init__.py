"""Spark jobs that map, query and prepare text corpora."""
