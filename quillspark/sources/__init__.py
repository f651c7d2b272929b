"""Readers and writers: document store, segments, edge lists, dictionaries."""
