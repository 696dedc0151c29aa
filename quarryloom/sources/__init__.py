"""Readers, parsers and state tables."""
