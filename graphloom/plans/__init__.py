"""Graphs over given tables, and queries composed of operators."""
