"""Functions of the recording-archive library."""
