"""plans of the byte analytics engine."""
