"""Statistics and preprocessing over sparse matrices."""
