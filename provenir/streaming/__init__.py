"""Streaming of the provenance engine."""
