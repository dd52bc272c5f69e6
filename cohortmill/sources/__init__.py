"""Readers with fixed schemas, writers, and materialised tables."""
