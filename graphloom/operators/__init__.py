"""Relational parts that plans are built from."""
