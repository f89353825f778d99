"""Catalyst column expressions (no Python evaluation)."""
