"""Incremental operators on Structured Streaming."""
