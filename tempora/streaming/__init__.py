"""Structured Streaming entry points (see hourly.py)."""
