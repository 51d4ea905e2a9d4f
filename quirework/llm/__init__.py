"""Training-data operators: tokens, duplicates, contamination, toxicity, HTML and fingerprints.

Nothing outside this subpackage imports it.  Every operator states in its docstring
what it returns for nulls, empty and very long texts, ties, repeated rows, empty
tables and extra columns.
"""
