"""Relational building blocks: batch updates, traversal, skew-safe joins and aggregates."""
