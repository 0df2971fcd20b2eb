"""functions of the change-evaluation engine."""
