"""Operators of the clearing engine."""
