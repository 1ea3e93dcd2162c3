"""Engram sources."""
