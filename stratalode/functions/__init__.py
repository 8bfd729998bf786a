"""Column functions: fixed word lists, paths, lines, language rules."""
