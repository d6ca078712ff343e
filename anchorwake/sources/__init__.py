"""Readers, writers and the event schema."""
