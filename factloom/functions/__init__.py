"""Functions: similarity, normalisation, statistics."""
