"""Structured Streaming forms of the ingest and of the drift monitor."""
