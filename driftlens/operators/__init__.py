"""operators of the change-evaluation engine."""
