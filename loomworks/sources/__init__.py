"""Loomworks sources."""
