"""Structured Streaming entry points (stateless cleaning + watermark dedupe)."""
