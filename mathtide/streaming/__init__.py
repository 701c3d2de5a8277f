"""Structured Streaming forms: file streams, per-batch shuffles, takes,
per-key aggregates and running metrics carried across micro-batches."""
