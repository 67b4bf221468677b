"""Readers, writers and file/link listings."""
