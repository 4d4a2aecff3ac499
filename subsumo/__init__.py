"""Subsumo: discovery of conditional inclusion dependencies on Spark."""
