"""Checks on streams with Structured Streaming."""
