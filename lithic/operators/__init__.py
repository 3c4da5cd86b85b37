"""Operators on row groups and their statistics."""
