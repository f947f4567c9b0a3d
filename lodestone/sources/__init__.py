"""Readers and loaders."""
