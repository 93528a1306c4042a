"""Incremental re-scan with Structured Streaming."""
