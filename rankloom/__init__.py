"""Retrieval, ranking and evaluation analytics as batch DataFrame programs on Spark."""
