"""Structured Streaming extension."""
