"""Relational operators over element tables."""
