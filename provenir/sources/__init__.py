"""Sources of the provenance engine."""
