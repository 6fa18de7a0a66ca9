"""Corpus operators for training data; nothing else in this package imports them."""
