"""Spark-first analytics over scanned reference material and the text tables around it."""
