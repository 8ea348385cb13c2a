"""Operators for building text training sets. Nothing else in the library imports this subpackage."""
