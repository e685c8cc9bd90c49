"""Readers by file kind, and the graph's exports."""
