"""Structured Streaming into a fact store."""
