"""Training-data operators: deduplication, extraction, scoring, tokenising and cleaning of text corpora.

Nothing outside this package imports it; it can be removed without effect on the signal operators.
"""
