"""Operators of the tessera engine."""
