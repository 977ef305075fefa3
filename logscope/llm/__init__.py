"""Operators for building training data from web text. Nothing else in the library imports this package."""
