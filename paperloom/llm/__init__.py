"""Operators for large training corpora. Nothing else in the package imports this folder."""
