"""Functions of the clearing engine."""
