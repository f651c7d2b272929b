"""Operators for preparing text at scale. Nothing else in the library imports this subpackage."""
