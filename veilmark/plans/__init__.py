"""plans of the text analytics engine."""
