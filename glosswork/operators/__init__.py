"""Operators of the phrase-table engine."""
