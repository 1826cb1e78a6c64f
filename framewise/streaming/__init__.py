"""Streaming forms of sequence operators."""
