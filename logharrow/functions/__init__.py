"""Column functions: columns in, column out."""
