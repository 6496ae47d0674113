"""Streams over the library's tables."""
