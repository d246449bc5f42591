"""Operators for preparing text corpora; nothing else in the package depends on them."""
