"""Whole jobs made of operators, and the registry of checked queries."""
