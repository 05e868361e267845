"""Operators for preparing training data; no other part of the library imports this subpackage."""
