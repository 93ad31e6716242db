"""Column functions: scalar parsing, labels, geometry, scores."""
