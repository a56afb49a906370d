"""Registered query plans (Spark) and their independent DuckDB oracles."""
