"""Column functions: column in, column out."""
