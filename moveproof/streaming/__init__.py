"""Structured Streaming forms of ingest, change apply, profiling and drift."""
