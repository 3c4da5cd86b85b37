"""Column transforms."""
