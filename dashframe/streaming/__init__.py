"""Structured Streaming form of the chart datasets."""
