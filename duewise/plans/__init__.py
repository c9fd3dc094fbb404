"""Plans of the clearing engine."""
