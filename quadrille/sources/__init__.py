"""Readers and writers of points."""
