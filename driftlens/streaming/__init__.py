"""streaming of the change-evaluation engine."""
