"""Incremental collection with Structured Streaming."""
