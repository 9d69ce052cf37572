"""Relational operators of the curation side."""
