"""Engram operators."""
