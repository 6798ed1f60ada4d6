"""Incremental feature maintenance with Structured Streaming."""
