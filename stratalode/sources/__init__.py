"""Sources of the source-corpus engine."""
