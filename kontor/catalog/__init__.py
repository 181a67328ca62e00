"""Registered queries, each with the DuckDB text of the same result where SQL can say it."""
