"""Operators for preparing text and vector corpora."""
