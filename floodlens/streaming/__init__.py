"""Structured Streaming jobs with the same results as the batch operators."""
