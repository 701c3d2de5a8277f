"""Column -> Column functions: answer rules (I1-I13), leaderboard fields
(I14-I19) and Python-compatible string helpers."""
