"""Readers, catalogue look-ups and sinks."""
