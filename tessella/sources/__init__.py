"""Readers and writers of text tables."""
