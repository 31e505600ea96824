"""Streams into the store."""
