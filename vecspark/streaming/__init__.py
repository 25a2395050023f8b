"""Structured Streaming into mutation logs and collections."""
