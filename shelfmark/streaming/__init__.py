"""Runs over arriving files, with Structured Streaming."""
