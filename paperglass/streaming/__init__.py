"""Incremental forms with Structured Streaming."""
