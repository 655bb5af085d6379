"""Column functions: the spatial grids."""
