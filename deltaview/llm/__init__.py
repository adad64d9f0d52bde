"""Corpus operators for training data: near-duplicates, tokens, quality, language.

Nothing else in the library imports this subpackage.
"""
