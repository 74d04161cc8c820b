"""Queries over the test tables, with their SQL for DuckDB."""
