"""Column functions that are built-in SQL expressions throughout."""
