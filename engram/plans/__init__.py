"""Engram plans."""
