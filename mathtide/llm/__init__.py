"""Training-data operators: thirteen steps of a corpus pipeline as Spark jobs."""
