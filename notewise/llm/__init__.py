"""Corpus operators for training data: counting, packing, scoring, matching, archiving, filtering.

Nothing else in the library imports this subpackage.
"""
