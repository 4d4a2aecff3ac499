"""Relational operators of the discovery."""
