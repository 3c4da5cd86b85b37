"""Declared models, their types, and their resolution against files."""
