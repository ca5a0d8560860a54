"""Loomworks streaming."""
