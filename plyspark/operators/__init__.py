"""Relational operators over the tables."""
