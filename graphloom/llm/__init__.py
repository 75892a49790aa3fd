"""Operators for building training corpora: one module per operator, plus ``registry`` with their queries and SQL."""
