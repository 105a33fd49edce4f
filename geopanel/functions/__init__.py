"""Column functions: missing-value semantics, geometry and special functions."""
