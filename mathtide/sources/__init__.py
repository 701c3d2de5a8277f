"""Readers (XML, JSON arrays, keyed JSON, JSONL, CSV, Parquet, file streams),
writers (split folders, result files) and footer-only Parquet statistics."""
