"""Belltower functions."""
