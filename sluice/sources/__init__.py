"""Readers, writers, databases and the catalog."""
