"""Structured Streaming: exactly-once incremental landing of raw extracts (the analytics are batch jobs)."""
