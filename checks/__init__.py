"""Registered queries over the given tables, their inputs and their DuckDB counterparts."""
