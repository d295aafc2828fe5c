"""Part of tidemark; see the README."""
