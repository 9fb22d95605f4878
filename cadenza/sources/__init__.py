"""Readers, and writers that can be repeated."""
