"""Operators over text corpora for training data: quality, duplicates, leaks, secrets, tokens."""
