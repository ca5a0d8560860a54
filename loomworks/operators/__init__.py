"""Loomworks operators."""
