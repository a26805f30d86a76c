"""Operators of a training-data pipeline: tokens, secrets, quality, dedup, search, mixing.

Nothing else in the library imports this subpackage.
"""
