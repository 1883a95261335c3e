"""Operators for preparing large training-data corpora. Nothing else in siderea imports this package."""
