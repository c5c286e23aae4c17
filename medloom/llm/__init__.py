"""Operators for large training-data collections. Nothing else in the library imports this subpackage."""
