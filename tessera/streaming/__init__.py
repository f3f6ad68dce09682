"""Streaming of the tessera engine."""
