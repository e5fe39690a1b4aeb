"""Spark-first analytics over recorder evidence and text corpora."""
