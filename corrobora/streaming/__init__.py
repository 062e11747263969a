"""Structured Streaming jobs: ingest, match, summaries, repeat suppression, lifecycle."""
