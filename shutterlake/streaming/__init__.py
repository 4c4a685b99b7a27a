"""Structured Streaming operators of the ingest."""
