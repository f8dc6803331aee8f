"""Structured Streaming: matching names as they arrive."""
