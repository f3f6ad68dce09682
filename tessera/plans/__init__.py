"""Plans of the tessera engine."""
