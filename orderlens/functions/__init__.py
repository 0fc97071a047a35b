"""functions of the commerce engine."""
