"""Structured Streaming versions: count windows, live alignment, stop rules."""
