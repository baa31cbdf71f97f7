"""operators of the byte analytics engine."""
