"""Whole discovery plans."""
