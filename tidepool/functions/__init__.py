"""Columns: text, values, predicates."""
