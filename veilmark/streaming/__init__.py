"""streaming of the text analytics engine."""
