"""Structured Streaming over the correction log."""
