"""PySpark engine for finding, resolving and rewriting structured identifiers in text."""
