"""Column builders: distributions, distances, bins and text forms."""
