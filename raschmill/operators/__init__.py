"""Operators over response, item and person tables."""
