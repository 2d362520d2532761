"""Structured Streaming forms of ingest and alerting (no server, no port:
file sources, ``availableNow`` triggers, file sinks)."""
