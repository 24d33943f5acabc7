"""Relational operators: ``DataFrame -> DataFrame`` functions."""
