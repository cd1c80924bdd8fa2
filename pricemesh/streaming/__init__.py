"""Idempotent daily ingest on Structured Streaming."""
