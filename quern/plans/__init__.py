"""Statements, predicates and the choice of what to read."""
