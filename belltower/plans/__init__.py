"""Belltower plans."""
