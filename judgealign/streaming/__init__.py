"""Incremental evaluation and running metrics on Structured Streaming."""
