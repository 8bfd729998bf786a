"""Plans of the source-corpus engine."""
