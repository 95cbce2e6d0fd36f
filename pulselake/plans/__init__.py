"""Queries over the driver tables, built from the operators."""
