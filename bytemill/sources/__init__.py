"""sources of the byte analytics engine."""
