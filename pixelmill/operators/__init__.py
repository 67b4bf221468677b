"""Operators from DataFrame(s) to DataFrame."""
