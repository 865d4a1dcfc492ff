"""functions of the text-part engine."""
