"""Functions of the tessera engine."""
