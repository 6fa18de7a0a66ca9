"""Sources of the phrase-table engine."""
