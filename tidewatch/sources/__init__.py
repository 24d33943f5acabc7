"""Readers, writers and reference tables."""
