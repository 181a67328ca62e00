"""Structured Streaming forms of ingest, alert rules and per-key guards."""
