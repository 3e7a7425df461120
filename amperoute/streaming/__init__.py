"""Structured Streaming forms of ingestion and the derived facts."""
