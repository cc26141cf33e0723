"""Operators on samples and batches."""
