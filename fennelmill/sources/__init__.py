"""Readers, writers, markup parsing and remote sources."""
