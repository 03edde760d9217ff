"""Structured Streaming jobs over the run log."""
