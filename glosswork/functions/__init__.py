"""Functions of the phrase-table engine."""
