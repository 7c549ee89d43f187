"""Graph algorithms as DataFrame loops."""
