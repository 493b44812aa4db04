"""Column builders: text analysis, globs, scores, vectors, ids and time."""
