"""Operators over resources, index rows and the version log."""
