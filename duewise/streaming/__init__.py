"""Streaming of the clearing engine."""
