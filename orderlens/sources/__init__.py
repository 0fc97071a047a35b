"""sources of the commerce engine."""
