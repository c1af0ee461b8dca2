"""Expressions that more than one module builds on."""
