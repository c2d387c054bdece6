"""Operators of the recording-archive library."""
