"""Melody analytics on Spark: note tables in, sequences, indexes and metrics out."""
