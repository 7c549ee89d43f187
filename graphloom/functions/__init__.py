"""Column functions and graph statistics."""
