"""Structured Streaming forms of the bar build and the overlap refresh."""
