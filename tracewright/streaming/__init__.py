"""Structured Streaming and incremental maintenance."""
