"""Loomworks plans."""
