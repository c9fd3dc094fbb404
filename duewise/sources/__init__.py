"""Sources of the clearing engine."""
