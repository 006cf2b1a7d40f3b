"""Operators on texts for model training; nothing else in the library imports this subpackage."""
