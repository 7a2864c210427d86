"""Operators of the provenance engine."""
