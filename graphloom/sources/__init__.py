"""Readers, writers and generators for graph data."""
