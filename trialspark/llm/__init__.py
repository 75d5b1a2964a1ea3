"""Operators for large text corpora: deduplication, scans, models, mixing.

Nothing else in the library imports this subpackage.
"""
