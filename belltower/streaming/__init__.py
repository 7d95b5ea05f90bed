"""Belltower streaming."""
