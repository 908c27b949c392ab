"""Structured Streaming jobs: idempotent ingest and stateful frame labelling."""
