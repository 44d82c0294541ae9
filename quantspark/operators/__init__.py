"""Relational operators over pages, statements, numbers and annotations."""
