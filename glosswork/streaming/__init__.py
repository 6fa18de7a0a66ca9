"""Streaming of the phrase-table engine."""
