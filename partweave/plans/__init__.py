"""plans of the text-part engine."""
