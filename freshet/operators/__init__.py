"""Relational operators: scaffolds, fills, checks, joins, aggregates, windows."""
