"""Continuous upkeep."""
