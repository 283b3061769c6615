"""Column functions: predicates, distances, curves and geometry."""
