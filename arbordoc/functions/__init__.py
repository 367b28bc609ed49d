"""Column functions: scalars, paths, arrays."""
