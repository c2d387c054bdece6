"""Streaming of the recording-archive library."""
