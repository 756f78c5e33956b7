"""Keyed event operators, for batches and for Structured Streaming."""
