"""Structured Streaming over page tables."""
