"""Readers and writers for the stored collections."""
