"""sources of the change-evaluation engine."""
