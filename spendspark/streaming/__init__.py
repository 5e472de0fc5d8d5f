"""Structured Streaming forms of ingest and scoring."""
