"""Restartable incremental ingest on Structured Streaming."""
