"""Structured Streaming jobs: incremental ingest, URL dedup, question answering."""
