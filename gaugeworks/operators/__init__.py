"""Relational operators over the record tables."""
