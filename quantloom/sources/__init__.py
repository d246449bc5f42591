"""Readers with fixed schemas, and the same tables derived from the test data."""
