"""functions of the byte analytics engine."""
