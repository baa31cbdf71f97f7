"""streaming of the byte analytics engine."""
