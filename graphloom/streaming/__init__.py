"""Structured Streaming adapters for edge batches."""
