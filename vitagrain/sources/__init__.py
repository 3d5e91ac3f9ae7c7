"""Readers, writers and corpora derived from stored tables."""
