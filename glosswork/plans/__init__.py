"""Plans of the phrase-table engine."""
