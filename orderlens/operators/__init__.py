"""operators of the commerce engine."""
