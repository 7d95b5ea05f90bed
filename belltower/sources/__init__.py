"""Belltower sources."""
