"""Readers, writers and merge rules of the tables."""
