"""Belltower operators."""
