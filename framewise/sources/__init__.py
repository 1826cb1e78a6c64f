"""Readers and writers of recording files."""
