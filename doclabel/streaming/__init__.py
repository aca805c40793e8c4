"""Incremental ingestion and labelling with Structured Streaming."""
