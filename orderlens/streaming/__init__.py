"""streaming of the commerce engine."""
