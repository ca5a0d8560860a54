"""Loomworks functions."""
