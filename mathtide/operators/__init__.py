"""DataFrame -> DataFrame operators: voting and accuracy, skew-safe ranking,
seeded sampling and hash-digit selection, record and prompt shaping, filters,
tokenisation, leaderboard, run logs and user-function batches."""
