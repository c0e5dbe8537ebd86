"""Readers, the canonical views and sinks."""
