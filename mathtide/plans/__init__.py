"""Composites over the driver tables: word-problem views, the evaluation and
curriculum plans, the registered queries and their DuckDB restatements."""
