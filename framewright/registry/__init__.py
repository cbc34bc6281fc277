"""Queries on the provided tables, a module per family, each with its SQL for DuckDB."""
