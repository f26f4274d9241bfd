"""Column functions: prices, titles, similarity."""
