"""Training-data operators: classifiers, deduplication, tokenization, filtering and mixing.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
