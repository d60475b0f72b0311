"""Relational operators over claims, records and graphs."""
