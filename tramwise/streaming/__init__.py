"""Streaming forms of the status and ridership reports."""
