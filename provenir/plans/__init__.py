"""Plans of the provenance engine."""
