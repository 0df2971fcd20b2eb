"""plans of the change-evaluation engine."""
