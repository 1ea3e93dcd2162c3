"""Engram streaming."""
