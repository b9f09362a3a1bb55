"""Structured Streaming alerts."""
