"""Rule cascades, hybrids and grids that combine the operators."""
