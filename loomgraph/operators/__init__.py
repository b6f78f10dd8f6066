"""Operators on run logs, overlays, graphs and their tables."""
