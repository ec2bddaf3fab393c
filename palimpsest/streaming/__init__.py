"""Stateful and windowed operators on Structured Streaming."""
