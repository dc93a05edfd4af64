"""Queries over the bench tables, each paired with a SQL twin."""
