"""operators of the text-part engine."""
