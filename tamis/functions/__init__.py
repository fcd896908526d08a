"""Column expressions and the numeric helpers that run inside Arrow batches."""
