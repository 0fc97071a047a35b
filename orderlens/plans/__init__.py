"""plans of the commerce engine."""
