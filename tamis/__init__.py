"""Triage analytics for embeddings on Spark: score, route, review, rank and evaluate as DataFrame operators."""
