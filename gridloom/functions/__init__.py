"""Column functions: NaN-aware arithmetic and aggregates, distances, time."""
