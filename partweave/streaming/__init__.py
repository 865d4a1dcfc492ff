"""streaming of the text-part engine."""
