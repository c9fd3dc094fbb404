"""Sinks of the clearing engine."""
