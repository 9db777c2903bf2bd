"""Structured Streaming over log sources."""
