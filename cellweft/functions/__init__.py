"""Column expressions: identity rules, intervals, scores and names."""
