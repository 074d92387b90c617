"""Bounded-memory output and incremental state as Structured Streaming."""
