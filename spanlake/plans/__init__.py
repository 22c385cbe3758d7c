"""Whole flows built from the operators, and the catalog of checked queries."""
