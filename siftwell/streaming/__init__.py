"""Structured Streaming sources, sinks and bounded state."""
