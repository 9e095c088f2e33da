"""Readers and writers of the document tables."""
