"""Engram functions."""
