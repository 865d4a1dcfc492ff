"""sources of the text-part engine."""
