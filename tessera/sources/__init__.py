"""Sources of the tessera engine."""
