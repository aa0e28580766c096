"""Operators for building training corpora from text; nothing else in the library imports this subpackage."""
