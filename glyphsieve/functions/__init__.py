"""LIKE compilation and literal-search column expressions."""
