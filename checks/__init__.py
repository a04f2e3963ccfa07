"""Comparison of the operators with plain SQL."""
