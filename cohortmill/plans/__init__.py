"""Whole cohort and matrix jobs composed from the operators."""
