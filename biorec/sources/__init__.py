"""Readers, normalisers and source filters."""
