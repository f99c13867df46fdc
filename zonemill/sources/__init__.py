"""Readers, sinks and provenance."""
