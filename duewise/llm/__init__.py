"""Operators for preparing large-scale training corpora; nothing outside this folder imports them."""
