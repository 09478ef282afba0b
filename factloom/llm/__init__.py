"""Operators of a training-data pipeline: extraction, near duplicates, quality, tokens, packing.

Nothing else in the library imports this subpackage.
"""
