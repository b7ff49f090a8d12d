"""Column functions for text and numbers."""
