"""sources of the text analytics engine."""
