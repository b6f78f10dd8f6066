"""Column functions: text, hashes, paths, JSON, globs."""
