"""Readers and writers: CSV table sets, JSON dimensions, state outlines, databases."""
